"""Plans that put feature families together: the message table, its contract, and triage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.refdata import RULES
from mailsift.operators import behaviour, links, messages, rules

GROUPS = ("email", "url", "behavioural")
_EMAIL, _URL = list(messages.FAMILIES), "link_"


def email_columns() -> dict[str, Column]:
    return messages.columns(*_EMAIL)


def message_table(mails: DataFrame, link_rows: DataFrame | None, groups: Iterable[str] = GROUPS, id: str = "message_id", canonical_urls: bool = True, only: Iterable[str] | None = None) -> DataFrame:
    """Every feature of every message, one row each, in the order of the contract.

    Text and context features are one projection of the messages; links are summed by message and joined
    once. ``groups`` leaves families out (for ablations), ``only`` all features but these; canonical_urls=False reads URLs as they are written.
    Values that are no numbers are 0, infinite ones 1e9. Rows with one id each keep their own features.
    """
    groups = [g for g in GROUPS if g in set(groups)]
    if not groups:
        raise ValueError("at least one feature family is required")
    x, found = messages.prepared(mails, id), {}
    email, wanted = email_columns(), None if only is None else set(only)
    some = lambda columns: {k: v for k, v in columns.items() if wanted is None or k in wanted}
    if "email" in groups:
        found |= some(email)
    own = [F.col(id), *(F.round(v, 6).alias(k) for k, v in found.items())]
    if "behavioural" in groups:
        own += [F.round(v, 6).alias(k) for k, v in some(behaviour.features(behaviour.context(x), *behaviour.signals(email))).items()]
    x = x.select(*own)
    if "url" in groups and link_rows is not None:
        family = links.link_family(links.link_features(link_rows, id, canonical_urls), id, wanted)
        names = [c for c in family.columns if c != id]
        x = links.neutral(x.join(family, id, "left"), names)
        first = [c for c in x.columns if c not in names and not c.startswith("beh_")]
        x = x.select(*first, *names, *(c for c in x.columns if c.startswith("beh_")))
    return x


def family_of(name: str) -> str:
    return "behavioural" if name.startswith("beh_") else "url" if name.startswith(("link_", "url_")) else "email" if name.startswith(("hdr_", "subj_", "body_", "html_", "obf_", "att_")) else "unknown"


def contract(table: DataFrame, id: str = "message_id") -> list[str]:
    """The names and order of a table's features."""
    return [c for c in table.columns if c != id]


def family_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """(position, name, family) of features."""
    return spark.createDataFrame([(i, n, family_of(n)) for i, n in enumerate(names)], "position int, name string, family string")


def verify(table: DataFrame, names: list[str], id: str = "message_id") -> DataFrame:
    """The table, where it has the features of a contract in its order; else a RuntimeError that names what is missing or unexpected."""
    own = contract(table, id)
    if own != names:
        missing, more = sorted(set(names) - set(own)), sorted(set(own) - set(names))
        raise RuntimeError(f"feature contract mismatch: {len(missing)} missing {missing[:3]}, {len(more)} unexpected {more[:3]}" + ("" if missing or more else ", another order"))
    return table


def rule_table(mails: DataFrame, link_rows: DataFrame, id: str = "message_id") -> DataFrame:
    """The features that rules read; the rest of the message table is never computed."""
    names = list(dict.fromkeys(r[2] for r in RULES))
    return message_table(mails, link_rows, id=id, only=names).select(id, *names)


def triage(mails: DataFrame, link_rows: DataFrame, id: str = "message_id") -> DataFrame:
    """Messages ranked for analysts."""
    return rules.triage(rule_table(mails, link_rows, id), id)
