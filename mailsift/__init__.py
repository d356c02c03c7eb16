"""Mail-threat analytics and corpus preparation as PySpark jobs."""
