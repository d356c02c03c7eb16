"""BPE encoding and decoding as streaming machines, over the merge list of a public tokenizer file.

Encoding is a transducer. For each prefix of a word, the last token of the prefix's encoding is
decided by the prefix alone: it is the one token that ends there and is compatible with the last
token before it, two tokens being compatible where merging their joined symbols gives them back.
A token spans at most ``lookahead`` symbols, so the encoding of whatever follows descends from one
of the last ``lookahead`` places; tokens before the place from which all of these descend are
stable. They are emitted and forgotten, so memory depends on the merge list, not on the input.

Decoding is the inverse, token by token: ``Decoder`` holds at most the three bytes of an unfinished
UTF-8 character. The tokenizers library has its own text form for a file that names no decoder, the
tokens joined by spaces; the machine gives it with ``joined``. The query's decoded text is what this
machine makes of the ids; as it stands between words as it began, a word's part is remembered.

Defined cases: null texts are empty and have no tokens (the digest of nothing); the strings of the
file's added tokens are tokens wherever they stand, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

#: Words and runs up to this many characters are remembered with their tokens; so many of each at most, in two generations.
MEMO_BYTES, MEMO_WORDS = 48, 200_000
#: The states of so many beginnings of words, of so many bytes, are remembered.
HEAD, HEADS = 5, 20_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Transducer:
    """Encoder over a merge list: the bytes of a word in, token ids out as soon as they are stable."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in reversed(list(enumerate(pairs)))}
        self.alphabet = byte_alphabet()
        byte = {c: b for b, c in self.alphabet.items()}
        self.names = {i: t for t, i in self.vocab.items()}
        self.none = max(self.names, default=0) + 1  # stands before the first token
        made = {a + b for a, b in self.rank}
        inner = [t for t in made | set(byte) if not (self.end and t.endswith(self.end))]
        final = [t for t in made | {c + self.end for c in byte} if t.endswith(self.end)] if self.end else inner
        # Tries of the tokens' bytes from last to first: (node, byte) -> node, and the token that a node ends.
        self.next: dict[int, int] = {}
        self.token: list[int] = [-1, -1]
        self.lookahead = max(self._plant(0, inner, "", byte), self._plant(1, final, self.end, byte))
        self.fits: dict[int, bool] = {}
        self.heads: dict[bytes, tuple[tuple[int, ...], tuple[int, ...]]] = {}  # where the first bytes of words lead

    def _plant(self, root: int, tokens: list[str], tail: str, byte: dict[str, int]) -> int:
        """Adds tokens to a trie; the length of the longest."""
        most = 1
        for name in tokens:
            if name not in self.vocab:
                continue
            node, body = root, name[: len(name) - len(tail)]
            for c in reversed(body):
                key = node << 8 | byte[c]
                if key not in self.next:
                    self.next[key] = len(self.token)
                    self.token.append(-1)
                node = self.next[key]
            self.token[node] = self.vocab[name]
            most = max(most, len(body))
        return most

    def _merge(self, parts: list[str]) -> list[str]:
        rank = self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _agree(self, before: int, token: int) -> bool:
        """Whether both stay as they are when they stand side by side."""
        names = [self.names[t] for t in (before, token) if t != self.none]
        found = self._merge([x for name in names for x in self._symbols(name)]) == names
        if len(self.fits) > 500_000:
            self.fits.clear()
        self.fits[before << 20 | token] = found
        return found

    def tokens(self, word: Iterable[int]) -> Iterator[int]:
        """Token ids of one word, given byte by byte."""
        text: list[int] = []  # bytes since the last stable place
        start, last = [-1], [self.none]  # of each place since: where its last token begins, and the token; -2: none ends there
        held, most = None, 4 * self.lookahead
        for b in word:
            if held is not None:
                self._step(text, start, last, held, 0)
                if len(text) >= most and (at := self._stable(start)):
                    yield from self._path(start, last, at)
                    text = text[at:]
                    last = last[at:]
                    start = [-1, *(p - at if p >= at else -2 for p in start[at + 1 :])]
            held = b
        if held is not None:
            self._step(text, start, last, held, 1)
            yield from self._path(start, last, len(text))

    def short(self, word: bytes) -> list[int]:
        """Token ids of a word of a few bytes, held whole: the same steps, with nothing to emit before its end."""
        following, token, fits = self.next.get, self.token, self.fits.get
        end = len(word) - 1
        known = self.heads.get(word[:HEAD]) if end >= HEAD else None
        start, last = ([*known[0]], [*known[1]]) if known else ([-1], [self.none])
        for i in range(len(start) - 1, end + 1):
            node = i == end
            if i == HEAD and known is None:
                if len(self.heads) >= HEADS:
                    self.heads.clear()
                self.heads[word[:HEAD]] = tuple(start), tuple(last)
            for at in range(i, -1, -1):
                node = following(node << 8 | word[at])
                if node is None:
                    start.append(-2)
                    last.append(self.none)
                    break
                t = token[node]
                if t >= 0 and start[at] != -2:
                    good = fits(last[at] << 20 | t)
                    if good or (good is None and self._agree(last[at], t)):
                        start.append(at)
                        last.append(t)
                        break
            else:
                start.append(-2)
                last.append(self.none)
        return self._path(start, last, end + 1)

    def _step(self, text: list[int], start: list[int], last: list[int], byte: int, root: int) -> None:
        text.append(byte)
        node, following, token, fits = root, self.next, self.token, self.fits
        for at in range(len(text) - 1, -1, -1):
            node = following.get(node << 8 | text[at])
            if node is None:
                break
            t = token[node]
            if t >= 0 and start[at] != -2:
                before = last[at]
                good = fits.get(before << 20 | t)
                if good or (good is None and self._agree(before, t)):
                    start.append(at)
                    last.append(t)
                    return
        start.append(-2)
        last.append(self.none)

    def _stable(self, start: list[int]) -> int:
        """The last place from which all of the last ``lookahead`` places descend."""
        front = {i for i in range(len(start) - self.lookahead, len(start)) if start[i] != -2}
        while len(front) > 1:
            top = max(front)
            front.remove(top)
            front.add(start[top])
        return max(front.pop(), 0)

    @staticmethod
    def _path(start: list[int], last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at = start[at]
        return out[::-1]


class Tokenizer:
    """Text to tokens for one tokenizer file: normaliser, word splitter, transducer, decoder."""

    def __init__(self, content: str):
        file = json.loads(content)
        self.machine = Transducer(file["model"])
        self.id = self.machine.vocab
        self.names = dict(self.machine.names)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.names |= {i: t for t, i in self.added.items()}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        split = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # Unicode white space: the control characters U+001C to U+001F aren't.
        self.split = regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}"))
        self.added_ids, self.bytes = set(self.added.values()), {c: b for b, c in byte_alphabet().items()}
        self.blank = regex.compile(r"\p{White_Space}+")
        self.memo, self.runs = Memo(self.word), Memo(self.run)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter, without the rule for final sigma

    def word(self, word: str) -> tuple[str, str]:
        """ids and tokens of one word, each joined by spaces."""
        data = word.encode("utf-8")
        if len(data) <= MEMO_BYTES:
            found, names = self.machine.short(data), self.names
            return " ".join(map(str, found)), " ".join([names[t] for t in found])
        found = list(self.machine.tokens(data))
        decoder = Decoder(self, joined=True)
        return " ".join(map(str, found)), "".join([decoder.feed(t) for t in found]) + decoder.close()

    def run(self, run: str) -> tuple[str, str]:
        """ids and tokens of a run of characters without white space, each joined by spaces."""
        memo, parts = self.memo, []
        if run.isascii() and run.isalpha():
            run = run.lower()
            return memo[run]
        for m in self.split.findall(self.normal(run)):
            parts.append(memo[m])
        return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def pieces(self, text: str) -> Iterator[tuple[str, str]]:
        """(ids, tokens) of each run and added token of a text."""
        return self._parted(text) if self.special and "<|" in text else self._runs(text)

    def _parted(self, text: str) -> Iterator[tuple[str, str]]:
        at = 0
        for m in self.special.finditer(text):
            yield from self._runs(text[at : m.start()])
            yield str(self.added[m[0]]), m[0]
            at = m.end()
        yield from self._runs(text[at:])

    def _runs(self, text: str) -> Iterator[tuple[str, str]]:
        # Neither the normaliser nor a word reaches across white space, so runs stand for themselves.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split(), not to the tokenizer
            return map(self.runs.__getitem__, filter(None, self.blank.split(text)))
        return map(self.runs.__getitem__, text.split())

    def digests(self, text: str, sink: list[str] | None = None) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the joined ids and of the decoded text, fed piece by piece.

        sink gets the ids, as numbers joined by spaces, of each piece.
        """
        ids, decoded, n, first = hashlib.sha256(), hashlib.sha256(), 0, True
        pieces = self.pieces(text)
        while part := list(islice(pieces, 20_000)):
            a = " ".join([p[0] for p in part])
            ids.update((a if first else " " + a).encode())
            if sink is not None:
                sink.append(a)
            b = " ".join([p[1] for p in part])
            decoded.update((b if first else " " + b).encode("utf-8"))
            n += a.count(" ") + 1
            first = False
        return n, ids.hexdigest(), decoded.hexdigest()

    def forget(self) -> None:
        self.memo.forget()
        self.runs.forget()

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.pieces(text) for i in ids.split()]

    def decode(self, ids: Iterable[int], joined: bool = False) -> str:
        decoder = Decoder(self, joined)
        return "".join(map(decoder.feed, ids)) + decoder.close()


class Memo(dict):
    """What a function gives for short strings. The older half goes when it is full, but for what is asked for again."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> tuple[str, str]:
        out = self.old.get(key) or self.make(key)
        if len(key) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Decoder:
    """Ids to text, token by token. Holds unfinished characters only.

    An end of word becomes a space; with ``joined`` tokens are named as they are, with spaces between them.
    """

    def __init__(self, tokenizer: Tokenizer, joined: bool = False):
        self.names, self.end, self.added = tokenizer.names, tokenizer.machine.end, tokenizer.added_ids
        self.byte, self.joined = tokenizer.bytes, joined
        self.held = b""
        self.begun = False

    def feed(self, token_id: int) -> str:
        name = self.names[token_id]
        if self.joined:
            name = " " + name if self.begun else name
            self.begun = True
            return name
        if token_id in self.added:
            return self.close() + name
        ends = bool(self.end) and name.endswith(self.end)
        self.held += bytes(self.byte[c] for c in (name[: -len(self.end)] if ends else name))
        out, at = [], 0
        while at < len(self.held):
            lead = self.held[at]
            need = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
            if at + need > len(self.held) and not ends:
                break
            out.append(self.held[at : at + need].decode("utf-8", "replace"))
            at += need
        self.held = self.held[at:]
        return "".join(out) + (" " if ends else "")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


_KNOWN: dict[str, Tokenizer] = {}


def tokenizer(content: str) -> Tokenizer:
    """The machine for a file's content, one for each Python worker."""
    if content not in _KNOWN:
        _KNOWN[content] = Tokenizer(content)
    return _KNOWN[content]


def encode(docs: DataFrame, file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds the ids."""
    with open(file or default_file(), encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = tokenizer(content.value)
        for part in parts:
            n, ids, decoded, lists = [], [], [], []
            for text in part.column("text"):
                text = text.as_py() or ""
                sink: list[str] | None = [] if with_ids else None
                a, b, c = machine.digests(text, sink)
                n.append(a)
                ids.append(b)
                decoded.append(c)
                if with_ids:
                    lists.append(np.array(" ".join(sink).split(), np.int32))
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        machine.forget()  # workers live on beyond their task

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, as digests."""
    return encode(table(spark, sf_dir, "documents"))
