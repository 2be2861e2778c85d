"""Byte-level BPE: exact token ids by dynamic programming over prefixes, and back to text.

The encoding of a text ends in one certain token for every prefix of the text. Going
through the prefixes, an automaton with suffix links names the tokens that end there,
longest first; the right one is that whose predecessor, the last token of the prefix
before it, is compatible: the merge rules turn the two tokens, written side by side, into
just these two. Following the tokens back from the end gives the ids. Time is linear in
the length of the text, whatever it is made of.

Two tokens are compatible when no rule joins a piece on the right edge of the first with
a piece on the left edge of the second while both are there. Pieces of an edge come and go
by the ranks of the rules that make and use them, so both edges are walked together once.

Added tokens of the vocabulary (like an end-of-text mark) are found in the text first, as
the library does with its defaults. Null text is an empty one and gives no ids; null ids
give an empty text; ids outside the vocabulary are skipped when decoding. The vocabulary
file is read by the driver (its size is checked) and broadcast; every Python worker builds
its automaton once. Caches in a worker are bounded and emptied when full; they hold
results of the method only.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.llm.common import unique_name
from postsift.session import ship_package

VOCABULARY_BYTES = 64 << 20
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64
DECODE_ROWS = 256
NEVER = 1 << 60
# Fixed pattern of byte-level vocabularies. Which later code points are letters or digits
# depends on the edition of Unicode, so texts with those are split by the library itself.
PIECES = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FIRST_UNSURE = "\u0500"
MARKS = ".,;:!?\"'()[]{}#$%&*+-/<=>@\\^_`|~"


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 stands
    for itself, the other bytes take the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict:
    """Token bytes by id, rules and added tokens of a tokenizer file, checked for kind."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec.get("normalizer"):
        raise ValueError("only byte-level BPE without a normalizer is known")
    letters = byte_letters()
    ids = model["vocab"]
    rules = [tuple(r.split(" ") if isinstance(r, str) else r) for r in model["merges"]]
    return {
        "key": uuid.uuid4().hex,
        "bytes": {i: bytes(letters[c] for c in token) for token, i in ids.items()},
        "rules": [(ids[a], ids[b], ids[a + b]) for a, b in rules],
        "added": {t["content"]: t["id"] for t in spec.get("added_tokens", [])},
        "prefix_space": pre.get("add_prefix_space", False),
    }


class Encoder:
    """Tables of one vocabulary, for use inside a task."""

    def __init__(self, vocabulary: dict):
        import ahocorasick
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        self.bytes = dict(vocabulary["bytes"])
        self.rank = {(a, b): r for r, (a, b, _) in reversed(list(enumerate(vocabulary["rules"])))}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b, made) in enumerate(vocabulary["rules"]):
            self.parts.setdefault(made, (a, b, r))
        self.known: dict[int, bool] = {}
        # Edges by token, as many as the vocabulary has at most.
        self.edges: tuple[dict, dict] = {}, {}
        usable = [i for i in sorted(self.bytes, key=lambda i: len(self.bytes[i])) if self._usable(i)]
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.sizes = [len(self.bytes.get(i, b"")) for i in range(max(self.bytes, default=-1) + 1)]
        self.pattern = regex.compile(PIECES)
        self.split = ByteLevel(add_prefix_space=vocabulary["prefix_space"]).pre_tokenize_str
        self.added = vocabulary["added"]
        self.bytes |= {i: text.encode() for text, i in self.added.items()}
        self.marks = re.compile("(" + "|".join(
            re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words, self.pieces = _Cache(), _Cache()
        self.table = None
        self.pairs: dict[int, bool] = {}
        self.line_feed = self._ids("\n")

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(piece, rank of the rule that uses it up) along an edge, from the innermost to the token itself."""
        edges = self.edges[side]
        edge = edges.get(token)
        if edge is None:
            piece, until, edge = token, NEVER, [(token, NEVER)]
            while piece in self.parts:
                *pieces, until = self.parts[piece]
                piece = pieces[side]
                edge.append((piece, until))
            edge.reverse()
            edges[token] = edge
        return edge

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether no rule below ``until`` joins the two tokens across their border."""
        one, two = self._edge(left, 1), self._edge(right, 0)
        rank, i, j = self.rank.get, 0, 0
        while True:
            (u, u_end), (v, v_end) = one[i], two[j]
            joined = rank((u, v), NEVER)
            # At one rank the rule works from the left: first inside the left token.
            if joined < u_end and joined <= v_end and joined < until:
                return False
            if u_end == v_end == NEVER:
                return True
            if u_end <= v_end:
                i += 1
            if v_end <= u_end:
                j += 1

    def _usable(self, token: int) -> bool:
        """Whether the rules make this token out of its own bytes, shorter tokens first."""
        if token not in self.known:
            parts = self.parts.get(token)
            self.known[token] = len(self.bytes[token]) == 1 if parts is None else (
                self._usable(parts[0]) and self._usable(parts[1])
                and self._apart(parts[0], parts[1], parts[2]))
        return self.known[token]

    def _word(self, word: str) -> list[int]:
        """Ids of a piece inside which the rules work without borders."""
        raw = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        pairs, sizes = self.pairs, self.sizes
        # The last token of the prefix that ends with each character.
        last = [-1] * len(raw)
        for end, token in self.automaton.iter(raw):
            if last[end] < 0:
                before = end - sizes[token]
                if before >= 0:
                    key = last[before] << 32 | token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= CACHE_ENTRIES:
                            pairs.clear()
                        fits = pairs[key] = self._apart(last[before], token, NEVER)
                    if not fits:
                        continue
                last[end] = token
        ids, at = [], len(raw) - 1
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= sizes[token]
        ids.reverse()
        return ids

    def _ids(self, piece: str) -> bytes:
        """Ids (int32) of one piece, as bytes; one after a space is kept as that word."""
        cache, key = self.pieces, piece
        if piece[0] == " " and not piece[-1].isspace():
            cache, key = self.words, piece[1:]
        found = cache.get(key)
        if found is None:
            found = array("i", self._word(piece)).tobytes()
            if len(piece) <= CACHE_CHARS:
                cache.put(key, found)
        return found

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a text that begins and ends at safe borders."""
        if max(chunk, default="") < FIRST_UNSURE:
            return b"".join(map(self._ids, self.pattern.findall(chunk)))
        return b"".join([self._ids(chunk[a:b]) for _, (a, b) in self.split(chunk)])

    def _part(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        A space between two characters that are not white space always begins a new
        piece, and a line feed there is one of its own; what follows is split without
        looking back. So the text is taken apart there, and words are looked up. A text
        where white space meets white space goes through its safe borders one by one.
        """
        get, made = self.words.young.get, []
        for line in text.split("\n"):
            if not line or line[0].isspace() or line[-1].isspace():
                return b"".join(map(self._chunk, _safe_parts(text)))
            first, *words = line.split(" ")
            found = list(map(get, words))
            if None in found:
                for at, ids in enumerate(found):
                    if ids is None:
                        ids = self._spaced(words[at])
                        if ids is None:
                            return b"".join(map(self._chunk, _safe_parts(text)))
                        found[at] = ids
                get = self.words.young.get
            made.append(self._first(first) + b"".join(found))
        return self.line_feed.join(made)

    def _spaced(self, word: str) -> bytes | None:
        """Ids of a space and a word; None unless the word begins and ends without white space."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        found = self.words.get(word)
        if found is None:
            if word.isalpha() and max(word) < FIRST_UNSURE:
                found = array("i", self._word(" " + word)).tobytes()
            else:
                # Marks after letters are a piece of their own, so the letters are looked up alone.
                letters = word.rstrip(MARKS)
                if letters.isalpha() and max(letters) < FIRST_UNSURE:
                    return self._spaced(letters) + self._ids(word[len(letters):])
                found = self._chunk(" " + word)
            if len(word) <= CACHE_CHARS:
                self.words.put(word, found)
        return found

    def _first(self, word: str) -> bytes:
        """Ids of a word at the beginning of a line."""
        letters = word.rstrip(MARKS)
        if letters.isalpha() and max(letters) < FIRST_UNSURE:
            return self._ids(letters) + (self._ids(word[len(letters):]) if len(letters) < len(word) else b"")
        return self._chunk(word)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as int32 bytes."""
        if self.marks is None:
            return self._part(text) if text else b""
        return b"".join([array("i", [self.added[p]]).tobytes() if p in self.added else self._part(p)
                         for p in self.marks.split(text) if p])

    def decode(self, ids, offsets) -> list[str]:
        """Texts of the lists of ids that the offsets cut out of one array.

        Bytes of all tokens are gathered from one table of them; unknown ids give none.
        """
        import numpy as np
        import pyarrow as pa
        if self.table is None:
            self.table = pa.array([self.bytes.get(i, b"") for i in range(max(self.bytes, default=-1) + 1)]
                                  + [b""], pa.large_binary())
        unknown = len(self.table) - 1
        known = (ids >= 0) & (ids < unknown)
        if not known.all():
            ids = np.where(known, ids, unknown)
        taken = self.table.take(pa.array(ids))
        _, places, body = taken.buffers()
        places = np.frombuffer(places, np.int64)[taken.offset:taken.offset + len(ids) + 1]
        whole = memoryview(body) if body is not None else b""
        ends = places[offsets].tolist()
        return [str(whole[a:b], "utf-8", "replace") for a, b in zip(ends, ends[1:])]


class _Cache:
    """Results by text in two generations: the older goes when the younger is full."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        self.young[key] = value


def _safe_parts(text: str) -> list[str]:
    pieces = text.split(" ")
    parts, current = [], pieces[0]
    open_end = not current or current[-1].isspace()
    for piece in pieces[1:]:
        if not piece:
            current, open_end = current + " ", True
            continue
        if open_end or piece[0].isspace():
            current = current + " " + piece
        else:
            parts.append(current)
            current = " " + piece
        open_end = piece[-1].isspace()
    parts.append(current)
    return parts


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: dict) -> Encoder:
    if vocabulary["key"] not in _encoders:
        _encoders.clear()
        _encoders[vocabulary["key"]] = Encoder(vocabulary)
    return _encoders[vocabulary["key"]]


class Tokenizer:
    """Column functions of one vocabulary file."""

    def __init__(self, spark: SparkSession, path: str):
        ship_package(spark)
        shared = spark.sparkContext.broadcast(read_vocabulary(path))

        @F.arrow_udf("array<int>")
        def ids_of(texts):
            import numpy as np
            import pyarrow as pa
            encode = _encoder(shared.value).encode
            found = [encode(t.as_py() or "") for t in texts]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(f) // 4 for f in found], out=offsets[1:])
            return pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))

        @F.arrow_udf("string")
        def text_of(ids):
            import numpy as np
            import pyarrow as pa
            found, rows = [], DECODE_ROWS
            for at in range(0, len(ids), rows):
                part = pa.array(ids.slice(at, rows).fill_null([]))
                flat = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                sizes = np.diff(part.offsets.to_numpy())
                found += _encoder(shared.value).decode(flat, np.concatenate(([0], np.cumsum(sizes))))
            return pa.array(found, pa.string())

        self._ids_of, self._text_of = ids_of, text_of

    def encode(self, text: Column | str) -> Column:
        return self._ids_of(text)

    def decode(self, ids: Column | str) -> Column:
        return self._text_of(ids)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of their texts in a new last column, named ``ids`` or, where
    there is such a column already, with underscores after it."""
    return docs.withColumn(unique_name(ids, docs.columns), Tokenizer(docs.sparkSession, path).encode(F.col(f"`{text}`")))
