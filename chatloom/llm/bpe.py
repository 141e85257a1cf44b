"""Exact byte-pair encoding by per-prefix dynamic programming.

For every prefix of a piece exactly one token can be the last of its encoding:
the token t that ends there, starts after a prefix with last token p, and for
which (p, t) is a pair that byte-pair encoding itself would leave standing. So
the whole encoding of a piece follows from one scan: an Aho-Corasick automaton
names the tokens that end at each byte, a compatibility test picks the one, and
back-pointers give the ids. The cost is linear in the piece, whatever its
length; merging pair by pair is quadratic on long unbroken runs.

Whether two tokens may stand side by side is decided by undoing their merges
from the seam outwards, latest merge first: if at any step the two tokens that
touch at the seam could have been merged before the merge just undone, the pair
would not have survived.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE = 200_000  # words a Python worker remembers
LONGEST_CACHED = 48

# fixed values: white space by Unicode's White_Space, and the public pre-tokenizer of the byte-level vocabulary
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

# A piece never runs from a non-space into a space, so words with the space before them can be encoded one by one.
_WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def read_vocabulary(path: str | Path) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank"."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _merge_history(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The last merge (left, right) that makes each token; bytes and tokens no merge makes are absent."""
    history: dict[int, tuple[int, int]] = {}
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                made = ranks.get(parts[i] + parts[i + 1], rank)
                if made < best:
                    best, at = made, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            history[rank] = (ranks[parts[0]], ranks[parts[1]])
    return history


class Encoder:
    """Encodes text with a byte-level vocabulary. One per Python worker."""

    def __init__(self, ranks: dict[bytes, int], history: dict[int, tuple[int, int]] | None = None):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.history = _merge_history(ranks) if history is None else history
        self.merged = {pair: token for token, pair in self.history.items()}
        self.pieces = regex.compile(PIECE)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or rank in self.history:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.stand: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether byte-pair encoding leaves ``left`` and ``right`` as neighbours."""
        known = self.stand.get((left, right))
        if known is None:
            if len(self.stand) > CACHE:
                self.stand.clear()
            known = self.stand[left, right] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        merged, history = self.merged, self.history
        # merges happen in order of rank, and from the left among equal ranks
        undone_rank, undone_right = 1 << 60, True
        while True:
            joint = merged.get((left, right))
            if joint is not None:
                if joint < undone_rank or (joint == undone_rank and undone_right):
                    return False
            from_left, from_right = history.get(left), history.get(right)
            if from_left is None and from_right is None:
                return True
            # undo the later of the two merges; of equal ones the right one is later
            if from_right is None or (from_left is not None and left > right):
                undone_rank, undone_right, left = left, False, from_left[1]
            else:
                undone_rank, undone_right, right = right, True, from_right[0]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        last = [-1] * (n + 1)
        start = [0] * (n + 1)
        compatible = self.compatible
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if begin == 0 or (last[begin] >= 0 and compatible(last[begin], token)):
                last[end], start[end] = token, begin
        if last[n] < 0:
            raise ValueError("the vocabulary has no token for some byte of the text")
        out = []
        at = n
        while at > 0:
            out.append(last[at])
            at = start[at]
        out.reverse()
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; a null or empty text gives none."""
        out: list[int] = []
        if not text:
            return out
        words = self.words
        for word in _WORD.findall(text):
            ids = words.get(word)
            if ids is None:
                found: list[int] = []
                for piece in self.pieces.findall(word):
                    found.extend(self.encode_piece(piece))
                ids = tuple(found)
                if len(word) <= LONGEST_CACHED:
                    if len(words) >= CACHE:
                        words.clear()
                    words[word] = ids
            out.extend(ids)
        return out


_encoders: dict[int, Encoder] = {}


def shared_encoder(share) -> Encoder:
    """The worker's encoder for a broadcast (vocabulary, merge history)."""
    found = _encoders.get(share.id if hasattr(share, "id") else id(share))
    if found is None:
        found = _encoders[share.id if hasattr(share, "id") else id(share)] = Encoder(*share.value)
    return found


class _Share:
    """A broadcast with a key that stays the same over the tasks of a worker."""

    def __init__(self, broadcast, key: str):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def vocabulary(spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY) -> _Share:
    """The vocabulary, read on the driver and sent to the executors (about 2 MB)."""
    import xxhash

    path = Path(folder) / name
    ranks = read_vocabulary(path)
    return _Share(spark.sparkContext.broadcast((ranks, _merge_history(ranks))), xxhash.xxh3_64_hexdigest(path.read_bytes()))


def encode_texts(df: DataFrame, text_col: str = "text", ids_col: str = "ids", folder: str = TOKENIZERS, name: str = VOCABULARY, only_count: bool = False) -> DataFrame:
    """``df`` with the token ids of each text (array<int>), or with their number (``only_count``).

    Whole texts are encoded; strings that look like special tokens are ordinary
    text. A null and an empty text give an empty list (or 0). A column already
    called ``ids_col`` is replaced. An empty table stays empty.
    """
    share = vocabulary(df.sparkSession, folder, name)
    df = df.drop(ids_col)
    at = df.columns.index(text_col)
    kind = "bigint" if only_count else "array<int>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{ids_col}` {kind}"

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(share)
        for batch in batches:
            names = [*batch.schema.names, ids_col]
            if only_count:
                sizes = [len(encoder.encode(t.as_py())) for t in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=names)
                continue
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                offsets, flat = [0], []
                for text in part.column(at):
                    flat.extend(encoder.encode(text.as_py()))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=names)

    return df.mapInArrow(fn, schema)


def count_tokens(df: DataFrame, text_col: str = "text", count_col: str = "n_tokens", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``df`` without the text, with its number of tokens."""
    return encode_texts(df, text_col, count_col, folder, name, only_count=True).drop(F.col(text_col))
