"""Rewrites of phishing mail: what an attacker changes without losing the lure, as columns over messages.

A rewrite is a set of columns in terms of a message's own. ``rewritten`` puts a row for each message and rewrite
beside the original in one pass and without a shuffle, ``valid`` tells whether the lure still works, ``sweep`` sums
scores before and after, and ``perturbed`` composes random rewrites for training. Draws are hashes of the seed, the
rewrite, the message and the place in it, so a lost task makes the same texts again.

Messages have message_id, subject, body, html, sender, reply_to, return_path, spf, dkim, dmarc, attachments,
received_hops and the sender context that the rewrites of behaviour change; a rewrite whose columns are missing never applies.
Words are runs of letters, apostrophes and hyphens that begin with a letter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import urls
from mailsift.functions.refdata import REDIRECT_PARAMS
from mailsift.functions.text import address, among, fold_confusables

from .links import hrefs
from .messages import ATTACHMENTS

# What words, letters and hosts are replaced by.
SYNONYMS = {
    "urgent": ["time-sensitive", "priority", "important"],
    "urgently": ["promptly", "at your earliest convenience", "without delay"],
    "immediately": ["promptly", "as soon as you can", "at your earliest convenience"],
    "verify": ["confirm", "review", "check", "complete"],
    "verification": ["confirmation", "review", "a quick check"],
    "confirm": ["review", "check", "complete"],
    "suspended": ["placed on hold", "paused", "temporarily unavailable"],
    "suspension": ["a temporary hold", "a pause", "an interruption"],
    "blocked": ["restricted", "paused", "limited"],
    "password": ["sign-in details", "access details", "login information"],
    "credentials": ["sign-in details", "access details"],
    "account": ["profile", "record", "membership"],
    "click": ["open", "follow", "use"],
    "expire": ["lapse", "end", "close"],
    "expires": ["lapses", "ends", "closes"],
    "expired": ["lapsed", "ended"],
    "warning": ["notice", "reminder", "update"],
    "alert": ["notice", "update", "message"],
    "unauthorized": ["unrecognised", "unexpected", "unfamiliar"],
    "unauthorised": ["unrecognised", "unexpected", "unfamiliar"],
    "failure": ["a problem", "an issue"],
    "permanently": ["for good", "without recovery"],
    "immediate": ["prompt", "timely"],
    "security": ["account", "access"],
    "final": ["last", "closing"],
    "must": ["will need to", "should"],
    "required": ["needed", "requested"],
}
PADDING = [
    "Thank you for your continued custom.",
    "This message was generated automatically; please do not reply directly.",
    "Our office hours are Monday to Friday, 9am to 5pm local time.",
    "For reference, your service agreement number is on your last statement.",
    "We have updated our privacy notice; a copy is available on request.",
    "If you have already actioned this, please disregard this message.",
    "A copy of this notice has been added to your document archive.",
    "Please retain this message for your records.",
    "Our support team is available through the usual channels.",
    "This notice is provided in line with our standard service terms.",
]
NEIGHBOURS = dict(zip("abcdefghijklmnopqrstuvwxyz", "qsz vgn xdv sfce wrd dgrv fhtb gjyn uok hkum jlim kop njk bhm ipl ol wa etf adwx ryg yih cfb qes zsc tuh asx".split(), strict=True))
GLYPHS = {
    **{"a": "аɑα", "c": "сϲ", "e": "еҽ", "i": "іıɩ", "j": "ј", "o": "оοᴏ", "p": "рρ", "s": "ѕ", "x": "хχ", "y": "уγ", "h": "һ", "k": "κ", "n": "ո", "b": "Ь", "d": "ԁ", "g": "ɡ", "l": "ӏ"},
    **{"A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "K": "КΚ", "M": "МΜ", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ"},
}
LEET = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5", "t": "7", "l": "1", "b": "8"}
ZERO_WIDTH = ["​", "‌", "‍", "⁠", "﻿"]
MARKS = ["́", "̀", "̈", "̄"]
HIDDEN = "password verify account suspend urgent confirm security login bank payment click expire".split()
SPLIT = "password verify account urgent suspended confirm security login payment bank".split()
ENCODED = "password verify account urgent confirm security login".split()
SPANNED = "password verify account urgent suspend confirm".split()
PRESSURE = r"(?i)within \d+ (?:hours?|days?|working days?)|\b(?:immediately|right away|act now|do not delay|before it is too late)\b|\bfinal (?:notice|warning|reminder)\b|\bexpires? (?:today|soon)\b|\bfailure to (?:comply|respond)[^.]*\.|\b(?:will be )?permanently (?:closed|suspended|deleted)[^.]*\."
SHORTENING = ["bit.ly", "tinyurl.com", "cutt.ly", "rb.gy", "is.gd", "t.ly"]
RELAYS = ["news-relay.example", "cdn-gateway.example", "go-track.example", "click-out.example", "link-svc.example"]
LABELS = "secure account login www verify signin auth id".split()
TRUSTED = "forms.gle docs.google.com storage.googleapis.com firebasestorage.googleapis.com notion.site webflow.io netlify.app pages.dev sites.google.com".split()
REDIRECTORS = ["www.google.com/url?q=", "l.facebook.com/l.php?u=", "out.reddit.com/t3?url=", "www.youtube.com/redirect?q="]
TRACKERS = ["u2731456.ct.sendgrid.net/ls/click?upn=", "links.mailchimp-proxy.example/track/click/", "email.mg.customer-notices.example/c/"]
RELOCATED = "gle google.com googleapis.com notion.site webflow.io netlify.app pages.dev sharepoint.com firebaseapp.com sendgrid.net".split()
CALLS = [
    "If you did not authorise this, our billing team can reverse the charge. Call {} within 24 hours; cancellations cannot be processed by email.",
    "To dispute this transaction, please call our support line on {}. Refunds are not available through the website.",
    "Questions about this renewal? Speak to an advisor on {}. Please have your order reference to hand.",
]
NAMES = ["Support", "Notifications", "Customer Service", "Service Desk", "Accounts", ""]
FILES = ["statement.pdf", "summary.pdf", "details.pdf", "notice.pdf", "report.pdf"]
ASKS = r"(?i)\b(verify|confirm|review|update|complete|open|follow|use|click|check|pay|restore|secure|proceed|sign|log|reset|unlock|submit|provide|send|reply|account|password|payment|invoice|details|code|wallet|refund)\b"
OUT_OF_BAND = r"(?i)\+?\d[\d ()\-]{7,}\d|\[QR code image\]|cid:qr-"

PIECES = r"[A-Za-z][A-Za-z'\-]*|[^A-Za-z]+"
WEB = r"(?i)^https?://[^\s<>\"'`\])]+"
TEXTS = ("subject", "body", "html")


class Draws:
    """Random numbers of one rewrite of one message, by place."""

    def __init__(self, rewrite: str, key: tuple[Column, ...]):
        self.key = (F.lit(rewrite), *key)

    def share(self, *at: Column | str) -> Column:
        """From 0 up to 1."""
        return F.pmod(F.xxhash64(*self.key, *(F.lit(a) if isinstance(a, str) else a for a in at)), F.lit(1 << 20)) / float(1 << 20)

    def upto(self, n: int | Column, *at) -> Column:
        """A whole number from 0, below n."""
        return F.floor(self.share(*at) * n).cast("int")

    def pick(self, options: list[str] | Column, *at) -> Column:
        options = F.array(*(F.lit(o) for o in options)) if isinstance(options, list) else options
        return F.get(options, self.upto(F.size(options), *at))

    def token(self, letters: str, n: int, *at) -> Column:
        return F.concat(*(F.substr(F.lit(letters), self.upto(len(letters), f"token{i}", *at) + 1, F.lit(1)) for i in range(n)))


def _words(text: Column, to: Callable[[Column, Column], Column]) -> Column:
    """The text with each word w at place i as to(w, i)."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda w, i: F.when(w.rlike("^[A-Za-z]"), to(w, i)).otherwise(w)), "")


def _letters(word: Column, to: Callable[[Column, Column], Column]) -> Column:
    return F.array_join(F.transform(F.split(word, ""), to), "")


def _table(known: dict[str, str], k: int) -> tuple[str, str]:
    """Letters, and the k-th (going round) of each one's replacements, as translate takes them."""
    return "".join(known), "".join(v[k % len(v)] for v in known.values())


def _inside(words: list[str], at: Callable[[str], int] = lambda w: len(w) // 2) -> str:
    """A pattern of the empty places within words."""
    return "(?i)" + "|".join(f"(?<={w[: at(w)]})(?={w[at(w) :]})" for w in words)


def _links(text: Column, to: Callable[[Column, Column], Column]) -> Column:
    """The text with each web address u at place i as to(u, i)."""

    def one(piece: Column, i: Column) -> Column:
        url = F.regexp_extract(piece, WEB, 0)
        return F.when(url == "", piece).otherwise(F.concat(to(url, i), F.substr(piece, F.char_length(url) + 1)))

    return F.array_join(F.transform(F.split(text, "(?i)(?=https?://)"), one), "")


def _synonyms(text: str, d: Draws, rate: float) -> Column:
    known = F.expr("map(" + ", ".join(f"'{k}', array({', '.join(repr(x) for x in v)})" for k, v in SYNONYMS.items()) + ")")

    def one(w: Column, i: Column) -> Column:
        other = d.pick(F.try_element_at(known, F.lower(w)), i, text)
        other = F.when(w.rlike("^[A-Z]"), F.concat(F.upper(F.substr(other, F.lit(1), F.lit(1))), F.substr(other, F.lit(2)))).otherwise(other)
        return F.when((d.share("whether", i, text) <= rate) & other.isNotNull(), other).otherwise(w)

    return _words(F.col(text), one)


def _typos(d: Draws) -> Column:
    # Of the first twelve long words, two fifths get a neighbouring key in place of an inner letter.
    head = F.regexp_extract("body", r"(?s)^(?:.*?[A-Za-z][A-Za-z'\-]{5,}){1,12}", 0)

    def one(w: Column, i: Column) -> Column:
        at = d.upto(F.char_length(w) - 2, "letter", i) + 2
        old = F.lower(F.substr(w, at, F.lit(1)))
        new = F.coalesce(*(F.when(d.upto(4, "key", i) == k, F.translate(old, *_table(NEIGHBOURS, k))) for k in range(4)))
        return F.when((F.char_length(w) >= 6) & (d.share("whether", i) <= 0.4), F.concat(F.substr(w, F.lit(1), at - 1), new, F.substr(w, at + 1))).otherwise(w)

    return F.concat(_words(head, one), F.substr("body", F.char_length(head) + 1))


def _softer(d: Draws) -> dict[str, Column]:
    plain = F.trim(F.regexp_replace(F.replace("subject", F.lit("!"), F.lit("")), r"(?i)\b(URGENT|IMPORTANT|ALERT|WARNING|FINAL NOTICE)\b[: ]*", ""))
    quiet = F.when((F.upper(plain) == plain) & (F.lower(plain) != plain), F.concat(F.substr(plain, F.lit(1), F.lit(1)), F.lower(F.substr(plain, F.lit(2))))).otherwise(plain)
    body = F.regexp_replace(F.regexp_replace("body", "!+", "."), r"(?i)\bDear (?:Customer|User|Valued Customer|Account Holder|Client|Member|Sir/Madam)\b", "Hello")
    shouted = lambda w, i: F.when(w.rlike("^[A-Z]{4,}$"), F.concat(F.substr(w, F.lit(1), F.lit(1)), F.lower(F.substr(w, F.lit(2))))).otherwise(w)
    return {"subject": F.when(quiet == "", F.col("subject")).otherwise(quiet), "body": _words(body, shouted)}


def _unhurried(d: Draws) -> dict[str, Column]:
    return {"body": F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("body", PRESSURE, ""), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))}


def _glyphs(text: str, d: Draws) -> Column:
    def one(c: Column, i: Column, j: Column) -> Column:
        k = d.upto(3, "which", i, j, text)
        return F.when(d.share(i, j, text) < 0.30, F.coalesce(*(F.when(k == x, F.translate(c, *_table(GLYPHS, x))) for x in range(3)))).otherwise(c)

    return _words(F.col(text), lambda w, i: _letters(w, lambda c, j: one(c, i, j)))


def _hidden(text: str, d: Draws) -> Column:
    return _words(F.col(text), lambda w, i: F.regexp_replace(w, F.lit(_inside(HIDDEN)), d.pick(ZERO_WIDTH, i, text)))


def _leet(d: Draws) -> Column:
    a, b = "".join(LEET), "".join(LEET.values())
    changed = lambda w, i: _letters(w, lambda c, j: F.when(d.share(i, j) < 0.45, F.translate(c, a + a.upper(), b + b)).otherwise(c))
    return _words(F.col("body"), lambda w, i: F.when((F.char_length(w) >= 5) & (d.share("whether", i) <= 0.5), changed(w, i)).otherwise(w))


def _broken(d: Draws) -> Column:
    def one(w: Column, i: Column) -> Column:
        sep = d.pick([" ", "-", ".", "_"], "mark", i)
        return F.when(d.share("place", i) < 0.5, F.regexp_replace(w, F.lit(_inside(SPLIT)), sep)).otherwise(F.regexp_replace(w, F.lit(_inside(SPLIT, lambda x: 3)), sep))

    return _words(F.col("body"), one)


def _marked(d: Draws) -> Column:
    return _words(F.col("body"), lambda w, i: _letters(w, lambda c, j: F.when(c.rlike("[A-Za-z]") & (d.share(i, j) < 0.10), F.concat(c, d.pick(MARKS, "mark", i, j))).otherwise(c)))


def _all_links(to: Callable[[Column, Column], Column]) -> dict[str, Column]:
    return {"body": _links(F.col("body"), to), "html": _links(F.col("html"), to)}


ALNUM = "abcdefghjkmnpqrstuvwxyz0123456789"


def _shortened(d: Draws) -> dict[str, Column]:
    return _all_links(lambda u, i: F.concat(F.lit("https://"), d.pick(SHORTENING, "host"), F.lit("/"), d.token(ALNUM, 7, i)))


def _relayed(d: Draws) -> dict[str, Column]:
    return _all_links(lambda u, i: F.concat(F.lit("https://"), d.pick(RELAYS), F.lit("/r?url="), F.url_encode(u)))


def _escaped(d: Draws) -> dict[str, Column]:
    def to(u: Column, i: Column) -> Column:
        site = F.regexp_extract(u, r"^[^:]+://[^/]*/", 0)
        path = _letters(F.substr(u, F.char_length(site) + 1), lambda c, j: F.when((j % 3 == 0) & c.rlike(r"[A-Za-z]"), F.concat(F.lit("%"), F.hex(F.ascii(c)))).otherwise(c))
        return F.when(site == "", u).otherwise(F.concat(site, path))

    return _all_links(to)


def _padded(d: Draws) -> dict[str, Column]:
    def to(u: Column, i: Column) -> Column:
        labels = F.array_join(F.transform(F.sequence(F.lit(1), d.upto(3, "n", i) + 2), lambda k: d.pick(LABELS, k, i)), ".")
        host = urls.host_of(u)
        return F.when((host == "") | host.rlike(urls.IPV4), u).otherwise(F.regexp_replace(u, F.lit(r"^([^:]+://)"), F.concat(F.lit("$1"), labels, F.lit("."))))

    return _all_links(to)


def _noisy(d: Draws) -> dict[str, Column]:
    return _all_links(lambda u, i: F.concat(u, F.when(F.contains(u, F.lit("?")), "&").otherwise("?"), F.lit("sid="), d.token(ALNUM, 18, i), F.lit("&ref="), (d.upto(8999, "ref", i) + 1000).cast("string")))


def _page() -> Column:
    return F.when(F.col("html") != "", F.col("html")).when(F.col("body") != "", F.concat(F.lit("<html><body><p>"), "body", F.lit("</p></body></html>"))).otherwise("")


def _entities(d: Draws) -> dict[str, Column]:
    trigger = "(?i)" + "|".join(ENCODED)
    coded = lambda w, i: _letters(w, lambda c, j: F.when(d.share(i, j) < 0.6, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c))
    return {"html": _words(_page(), lambda w, i: F.when(w.rlike(f"{trigger}"), coded(w, i)).otherwise(w))}


def _imaged(d: Draws) -> dict[str, Column]:
    link = F.col("_first")
    html = F.concat(F.lit('<html><body><img src="cid:notice.png" alt="" width="600" height="420"><br><a href="'), link, F.lit('">'), link, F.lit("</a></body></html>"))
    return {"body": F.concat(F.lit("(view this message in HTML)\n\n"), link), "html": html}


def _tags(d: Draws) -> dict[str, Column]:
    noise = F.array_join(F.transform(F.sequence(F.lit(1), d.upto(12, "n") + 6), lambda k: F.concat(F.lit('<div class="c'), (d.upto(899, k) + 100).cast("string"), F.lit('"><span></span></div>'))), "")
    page = _page()
    at = F.instr(page, "<body>")
    return {"html": F.when(at > 0, F.concat(F.substr(page, F.lit(1), at + 5), noise, F.substr(page, at + 6))).otherwise(page)}


def _renamed(d: Draws) -> dict[str, Column]:
    return {"attachments": F.transform("attachments", lambda a, i: F.struct(d.pick(FILES, i).alias("filename"), F.lit("application/pdf").alias("content_type"), a["size_bytes"].alias("size_bytes")))}


def _named(d: Draws) -> dict[str, Column]:
    name, addr = d.pick(NAMES), address(F.col("sender"))
    return {"sender": F.when(name == "", addr).otherwise(F.concat(name, F.lit(" <"), addr, F.lit(">")))}


def _first_as(new: Column) -> dict[str, Column]:
    return {"body": F.replace("body", F.col("_first"), new), "html": F.replace("html", F.col("_first"), new)}


def _rehosted(d: Draws) -> dict[str, Column]:
    return _first_as(F.concat(F.lit("https://"), d.pick(TRUSTED), F.lit("/"), d.pick(["d", "view", "s", "file"], "part"), F.lit("/"), d.token(ALNUM, 16)))


def _laundered(d: Draws) -> dict[str, Column]:
    return _first_as(F.concat(F.lit("https://"), d.pick(REDIRECTORS), F.url_encode("_first")))


def _tracked(d: Draws) -> dict[str, Column]:
    return _first_as(F.concat(F.lit("https://"), d.pick(TRACKERS), d.token("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 24)))


def _called(d: Draws) -> dict[str, Column]:
    number = F.concat(F.lit("+1 (8"), d.upto(9, "a").cast("string"), d.upto(9, "b").cast("string"), F.lit(") 555-0"), (d.upto(100, "c") + 100).cast("string"))
    body = F.rtrim(F.replace(F.replace("body", F.col("_first"), F.lit("")), F.lit("\n\n\n"), F.lit("\n\n")))
    return {"body": F.concat(body, F.lit("\n\n"), F.replace(d.pick(CALLS), F.lit("{}"), number)), "html": F.lit("")}


def _scanned(d: Draws) -> dict[str, Column]:
    body = F.concat(F.replace("body", F.col("_first"), F.lit("[QR code image]")), F.lit("\n\nScan the code above with your phone camera to continue. If it will not scan, reply to this message."))
    return {"body": body, "html": F.concat(F.lit('<html><body><img src="cid:qr-'), d.token("abcdef0123456789", 10), F.lit('" width="220" height="220" alt=""></body></html>'))}


@dataclass(frozen=True)
class Rewrite:
    """``to`` gives the columns it changes; it applies where ``where`` (SQL) holds and something changes."""

    id: str
    family: str
    name: str
    channel: str
    to: Callable[[Draws], dict[str, Column]]
    where: str = "true"


def _set(**values) -> Callable[[Draws], dict[str, Column]]:
    return lambda d: {k: F.lit(v) for k, v in values.items()}


LINKED = "_first is not null"
REWRITES = [
    Rewrite("A-LEX-01", "A-LEX", "Synonyms", "text", lambda d: {"subject": _synonyms("subject", d, 0.85), "body": _synonyms("body", d, 0.75)}),
    Rewrite("A-LEX-02", "A-LEX", "Typing errors", "text", lambda d: {"body": _typos(d)}),
    Rewrite("A-LEX-03", "A-LEX", "Harmless padding", "text", lambda d: {"body": F.concat("body", F.lit("\n\n"), F.array_join(F.array_distinct(F.transform(F.sequence(F.lit(1), d.upto(3, "n") + 2), lambda k: d.pick(PADDING, k))), "\n"))}),
    Rewrite("A-LEX-04", "A-LEX", "Softer tone", "text", _softer),
    Rewrite("A-LEX-05", "A-LEX", "No deadline", "text", _unhurried),
    Rewrite("A-UNI-01", "A-UNI", "Lookalike letters", "text", lambda d: {t: _glyphs(t, d) for t in ("subject", "body")}),
    Rewrite("A-UNI-02", "A-UNI", "Characters without width", "text", lambda d: {t: _hidden(t, d) for t in ("subject", "body")}),
    Rewrite("A-UNI-03", "A-UNI", "Digits for letters", "text", lambda d: {"body": _leet(d)}),
    Rewrite("A-UNI-04", "A-UNI", "Split words", "text", lambda d: {"body": _broken(d)}),
    Rewrite("A-UNI-05", "A-UNI", "Diacritics", "text", lambda d: {"body": _marked(d)}),
    Rewrite("A-URL-01", "A-URL", "Shortened links", "url", _shortened),
    Rewrite("A-URL-02", "A-URL", "Links through a relay", "url", _relayed),
    Rewrite("A-URL-03", "A-URL", "Percent escapes", "url", _escaped),
    Rewrite("A-URL-04", "A-URL", "Reassuring labels", "url", _padded),
    Rewrite("A-URL-05", "A-URL", "Noise in the query", "url", _noisy),
    Rewrite("A-URL-06", "A-URL", "Plain http", "url", lambda d: _all_links(lambda u, i: F.regexp_replace(u, "^https://", "http://"))),
    Rewrite("A-STR-01", "A-STRUCT", "Character references", "html", _entities),
    Rewrite("A-STR-02", "A-STRUCT", "Invisible spans", "html", lambda d: {"html": F.regexp_replace(_page(), _inside(SPANNED), '<span style="font-size:0">x</span>')}),
    Rewrite("A-STR-03", "A-STRUCT", "Text as an image", "html", _imaged, LINKED),
    Rewrite("A-STR-04", "A-STRUCT", "Empty tags", "html", _tags),
    Rewrite("A-HDR-01", "A-HDR", "No Reply-To", "header", _set(reply_to=""), "reply_to <> ''"),
    Rewrite("A-HDR-02", "A-HDR", "Neutral display name", "header", _named, "sender like '%@%'"),
    Rewrite("A-HDR-03", "A-HDR", "Authentication passes", "header", _set(spf="pass", dkim="pass", dmarc="pass")),
    Rewrite("A-HDR-04", "A-HDR", "Aligned return path", "header", lambda d: {"return_path": F.when(address(F.col("return_path")) == address(F.col("sender")), F.col("return_path")).otherwise(F.col("sender"))}, "return_path <> ''"),
    Rewrite("A-HDR-05", "A-HDR", "Harmless attachment names", "header", _renamed, "size(attachments) > 0"),
    Rewrite("A-HDR-06", "A-HDR", "Fewer hops", "header", _set(received_hops=3), "received_hops > 3"),
    Rewrite("A-BEH-01", "A-BEH", "Office hours", "behavioral", lambda d: {"hour_local": d.upto(9) + 9, "is_weekend": F.lit(False)}, "not (hour_local between 9 and 17 and not is_weekend)"),
    Rewrite("A-BEH-02", "A-BEH", "Low and slow", "behavioral", _set(burst_count_1h=1, recipient_count=1, bcc_count=0), "burst_count_1h > 2 or recipient_count > 2"),
    Rewrite("A-BEH-03", "A-BEH", "Framed as a reply", "behavioral", lambda d: {"subject": F.concat(F.lit("Re: "), "subject"), "thread_depth": d.upto(4) + 1}, "lower(subject) not like 're:%'"),
    Rewrite("A-BEH-04", "A-BEH", "One identity", "behavioral", _set(display_name_alias_count=1), "display_name_alias_count > 1"),
    Rewrite("A-TRUST-01", "A-TRUST", "Moved to a known platform", "url", _rehosted, LINKED),
    Rewrite("A-TRUST-02", "A-TRUST", "Through a known redirector", "url", _laundered, f"{LINKED} and not ({' or '.join(f'contains(_first, {h.split("/")[0]!r})' for h in REDIRECTORS)})"),
    Rewrite("A-TRUST-03", "A-TRUST", "Through a click tracker", "url", _tracked, f"{LINKED} and not (contains(_first, 'ct.sendgrid') or contains(_first, '/track/click/'))"),
    Rewrite("A-CHAN-01", "A-CHANNEL", "A number to call", "structure", _called, LINKED),
    Rewrite("A-CHAN-02", "A-CHANNEL", "A code to scan", "structure", _scanned, LINKED),
]
BY_ID = {r.id: r for r in REWRITES}


def _ready(messages: DataFrame) -> DataFrame:
    """Texts without nulls, and ``_first``, the first web link."""
    x = messages.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in (*TEXTS, "sender", "reply_to", "return_path") if c in messages.columns})
    if "attachments" in x.columns:
        x = x.withColumn("attachments", F.col("attachments").cast(ATTACHMENTS))  # new names may be null by type
    found = F.filter(hrefs(F.concat_ws("\n", "html", "body")), lambda u: u.rlike(WEB))
    return x.withColumn("_first", F.get(found, F.lit(0)))


def applied(x: DataFrame, which: Column, key: tuple[Column, ...], rewrites: Iterable[Rewrite] = REWRITES) -> DataFrame:
    """x, made by ``_ready``, with the columns that the rewrite ``which`` (an id, or null for none) gives each row, and ``changed``."""
    cases: dict[str, list[Column]] = {}
    for r in rewrites:
        new = r.to(Draws(r.id, key))
        if not set(new) <= set(x.columns):
            continue
        for c, to in new.items():
            cases.setdefault(c, []).append(F.when((which == r.id) & F.expr(r.where), to.cast(x.schema[c].dataType)))
    # Kept behind a generator, so that no later condition repeats the texts' expressions.
    out = urls.settled(x.select("*", *(F.coalesce(*to, F.col(c)).alias(f"_n_{c}") for c, to in cases.items())))
    changed = ~F.coalesce(*(F.when(~F.col(c).eqNullSafe(F.col(f"_n_{c}")), F.lit(False)) for c in cases), F.lit(True))
    out = out.withColumn("changed", changed)
    return out.withColumns({f"_o_{c}": F.col(c) for c in TEXTS}).withColumns({c: F.col(f"_n_{c}") for c in cases}).drop(*(f"_n_{c}" for c in cases))


def destinations(links: Column) -> Column:
    """The registered domains that links lead to, redirect parameters unwrapped up to three times and lookalike letters folded."""
    param = rf"(?i)[?&](?:{'|'.join(REDIRECT_PARAMS)})=([^&#]+)"

    def inner(u: Column) -> Column:
        t = F.regexp_extract(u, param, 1)
        t = F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)
        return F.when(t.rlike("(?i)^https?://"), t).otherwise(u)

    for _ in range(3):
        links = F.transform(links, inner)
    return F.array_remove(F.array_distinct(registered(links)), "")


def registered(links: Column) -> Column:
    hosts = F.transform(F.transform(links, lambda u: fold_confusables(urls.host_of(u))), lambda h: F.struct(h.alias("h"), urls.suffix_of(h).alias("s")))
    return F.transform(hosts, lambda x: urls.registered_domain(x["h"], x["s"]))


def valid(x: DataFrame) -> DataFrame:
    """x, made by ``applied``, with ``valid``: whether the message changed and is still a working lure.

    A link must lead where one of the original's led, be shortened or stand on a platform that content moves to; without links a number to call or a code
    to scan must be left. Something must still be asked for, and the message may not shrink to a quarter (without links, the body to 35 %).
    """
    links = lambda p: hrefs(F.concat_ws("\n", f"{p}html", f"{p}body"))
    # Links are looked for only where something changed and something is asked for.
    may = F.col("changed") & F.concat_ws(" ", *TEXTS).rlike(ASKS)
    y = urls.settled(x.withColumn("_may", F.coalesce(may, F.lit(False))))
    y = urls.settled(y.withColumns({k: F.when(F.col("_may"), links(p)) for k, p in (("_old", "_o_"), ("_new", ""))}))
    y = urls.settled(y.withColumns({"_from": destinations(F.col("_old")), "_to": destinations(F.col("_new")), "_direct": registered(F.col("_new"))}))
    size = lambda p: F.char_length(f"{p}subject") + F.char_length(F.trim(f"{p}body")) + F.char_length(f"{p}html")
    moved = F.exists("_direct", lambda h: among(h, SHORTENING + RELOCATED)) | F.exists("_new", lambda u: F.coalesce(*(F.when(F.contains(u, F.lit(r.split("/")[0])), F.lit(True)) for r in REDIRECTORS), F.lit(False)))
    reached = moved | (F.size("_from") == 0) | F.arrays_overlap("_from", "_to")
    whole = size("") >= F.greatest(F.lit(20), F.floor(size("_o_") * 0.25))
    body = F.char_length(F.trim("body")) >= F.greatest(F.lit(40), F.floor(F.char_length("_o_body") * 0.35))
    gone = F.concat_ws(" ", "body", "html").rlike(OUT_OF_BAND) & body
    ok = F.col("_may") & F.when(F.size("_old") == 0, whole).when(F.size("_new") == 0, gone).otherwise(reached & whole)
    return y.withColumn("valid", ok).drop("_old", "_new", "_from", "_to", "_direct", "_first", "_may", *(f"_o_{c}" for c in TEXTS))


def rewritten(messages: DataFrame, rewrites: Iterable[Rewrite] = REWRITES, id: str = "message_id", seed: int = 11) -> DataFrame:
    """A row for each message and rewrite that changes it and leaves the lure working: the columns of messages, and ``rewrite``."""
    rewrites = list(rewrites)
    x = _ready(messages).select("*", F.explode(F.array(*(F.lit(r.id) for r in rewrites))).alias("rewrite"))
    return valid(applied(x, F.col("rewrite"), (F.lit(seed), F.col(id)), rewrites)).filter("changed and valid").select(*messages.columns, "rewrite")


def perturbed(messages: DataFrame, copies: int = 1, steps: int = 3, id: str = "message_id", seed: int = 7) -> DataFrame:
    """``copies`` rows a message, each after one to ``steps`` random rewrites: the columns of messages, ``copy``, and ``rewrites``, the ids of those that held.

    Each step draws one rewrite for the message as it then is; one that does not change it, or leaves no lure, is taken back.
    """
    state = [c for c in messages.columns if c != id]
    x = messages.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in TEXTS}).select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy")).withColumn("rewrites", F.array().cast("array<string>"))
    x = x.withColumns({f"_0_{c}": F.col(c) for c in TEXTS})
    for step in range(steps):
        key = (F.lit(seed), F.lit(step), F.col(id), F.col("copy"))
        wanted = Draws("steps", (F.lit(seed), F.col(id), F.col("copy"))).upto(steps, "n") >= step
        which = F.when(wanted, Draws("which", key).pick([r.id for r in REWRITES]))
        y = _ready(x).withColumn("_which", which).withColumn("_was", F.struct(*state))
        y = applied(y, F.col("_which"), key).withColumns({f"_o_{c}": F.col(f"_0_{c}") for c in TEXTS})
        y = valid(y).withColumn("_ok", F.col("changed") & F.col("valid"))
        x = y.select(id, *(F.when(F.col("_ok"), F.col(c)).otherwise(F.col("_was")[c]).alias(c) for c in state), *(f"_0_{c}" for c in TEXTS), "copy", F.when(F.col("_ok"), F.array_append("rewrites", F.col("_which"))).otherwise(F.col("rewrites")).alias("rewrites"))
    return x.select(*messages.columns, "copy", "rewrites")


def registry(spark) -> DataFrame:
    return spark.createDataFrame([(r.id, r.family, r.name, r.channel) for r in REWRITES], "rewrite string, family string, name string, channel string")


def paired(before: DataFrame, after: DataFrame, id: str = "message_id") -> DataFrame:
    """(id, rewrite, family, before, after) of (id, score) and (id, rewrite, score)."""
    x = after.select(id, "rewrite", F.col("score").alias("after")).join(before.select(id, F.col("score").alias("before")), id)
    return x.join(F.broadcast(registry(before.sparkSession).select("rewrite", "family")), "rewrite").select(id, "rewrite", "family", "before", "after")


def sweep(pairs: DataFrame, messages: int | Column, threshold: float = 0.5) -> DataFrame:
    """Of each rewrite: how many messages it applies to, the mean and largest drop of the score, and the share that it takes below the threshold of those above."""
    drop, risk = F.col("before") - F.col("after"), F.col("before") >= threshold
    x = pairs.groupBy("rewrite").agg(F.count(F.lit(1)).alias("applicable"), F.avg(drop).alias("d"), F.max(drop).alias("m"), F.count_if(risk).alias("r"), F.count_if(risk & (F.col("after") < threshold)).alias("e"))
    n = messages if isinstance(messages, Column) else F.lit(messages)
    x = F.broadcast(registry(pairs.sparkSession)).join(x, "rewrite", "left").na.fill(0)
    share = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    return x.select("rewrite", "family", "name", "channel", "applicable", share(F.col("applicable"), n).alias("applicability"), F.round("d", 5).alias("mean_drop"), F.round("m", 5).alias("max_drop"), share(F.col("e"), F.col("r")).alias("evasion_rate"))


def worst_by_family(pairs: DataFrame, id: str = "message_id") -> DataFrame:
    """(id, family, before, after, queries): of each message and family the rewrite that lowers the score most, and the number tried."""
    return pairs.groupBy(id, "family").agg(F.first("before").alias("before"), F.min("after").alias("after"), F.count(F.lit(1)).alias("queries"))
