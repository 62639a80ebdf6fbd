"""Token counts and ids by a map-side two-tier lookup.

A byte-level BPE splits a text into pre-tokens that never reach across a single space standing
between two other characters, so a text may be cut there and each piece, of one pre-token or a few,
encoded alone. Tier one
is a compact table of frequent pieces, built from a bounded sample of rows and broadcast; what
it lacks is encoded once per worker and kept in tier two, a bounded cache. Nothing is shuffled,
and the sample decides only which pieces are found early, never a count.
"""

from __future__ import annotations

import json
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Rows sampled for tier one and their longest, the pieces it holds, and the most that a worker's cache holds, with the longest.
SAMPLE_ROWS, SAMPLE_CHARS, FREQUENT, CACHE, LONGEST = 1_000, 16_384, 20_000, 500_000, 64
#: Fixed value: how a byte-level pre-tokenizer splits a text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Python's white space holds all of the tokenizer's, so a cut is never inside a run of it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r" \s|\s ")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _library(path: str):
    """(ids of a text without special tokens, strings that stand for one id, whether pieces may be cut at spaces)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda text: model.encode(text, num_threads=1)), {}, False
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    before = spec.get("pre_tokenizer") or {}
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    plain = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip")) for t in spec.get("added_tokens", ()))
    cut = bool(byte_level and plain and not spec.get("normalizer"))
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())} if cut else {}
    encode = _by_rank(spec, added) if cut else None
    return encode or (lambda text: tokenizer.encode(text, add_special_tokens=False).ids), added, cut


def _by_rank(spec: dict, added: dict[str, int]):
    """The same ids by a merger of byte ranks, or None if the vocabulary's order isn't that of its merges."""
    model = spec["model"]
    vocab, merges = model.get("vocab", {}), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    made = [vocab.get("".join(m), -1) for m in merges]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or made != sorted(set(made)) or sum(x not in added for x in vocab) - len(made) != 256 or min(made, default=0) < 256:
        return None
    import tiktoken

    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte[c] for c in piece): k for piece, k in vocab.items() if piece not in added}
    return tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Tier(dict):
    """Tier one, and a bounded cache, in two generations, of what was looked up or encoded; long pieces are not kept."""

    def __init__(self, encode, lead: str, frequent: dict):
        super().__init__()
        self.encode, self.lead, self.frequent, self.old = encode, lead, frequent, {}

    def __missing__(self, piece: str):
        found = self.frequent.get(piece)
        if found is None:
            found = self.old.get(piece)
        if found is None:
            end = piece[-1:]
            if end in (",", ".") and piece[:-1].isalpha():  # letters and a mark are pre-tokens of their own
                found = self[piece[:-1]] + self.encode(end)
            else:
                found = self.encode(self.lead + piece)
        if len(piece) <= LONGEST:
            if len(self) > CACHE // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Counter2:
    """Token numbers or ids of texts; of="n" gives numbers, of="ids" little-endian uint32 bytes."""

    def __init__(self, path: str, of: str = "n", frequent: dict[str, int] | None = None):
        self.ids, self.added, self.cut = _library(path)
        self.of = of
        value = self._value
        self.first, self.rest = _Tier(value, "", {}), _Tier(value, " ", frequent or {})
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _value(self, text: str):
        ids = self.ids(text)
        return len(ids) if self.of == "n" else _bytes(ids)

    def _plain(self, text: str):
        pieces = _CUT.split(text) if _RUN.search(text) else text.split(" ")
        head, tail = self.first[pieces[0]], map(self.rest.__getitem__, pieces[1:])
        return head + sum(tail) if self.of == "n" else head + b"".join(tail)

    def __call__(self, text: str):
        if not self.cut:
            return self._value(text)
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        one = (lambda x: 1) if self.of == "n" else (lambda x: _bytes([self.added[x]]))
        parts = [one(x) if k % 2 else self._plain(x) for k, x in enumerate(self.special.split(text))]
        return sum(parts) if self.of == "n" else b"".join(parts)


def frequent_pieces(docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, keep: int = FREQUENT) -> dict[str, int]:
    """Token numbers of the most frequent pieces in a bounded sample of rows: tier one (keep pieces at most).

    The sample is the first rows found whose text has SAMPLE_CHARS or fewer, so few partitions are
    opened and the driver holds little.
    """
    if not _library(path)[2]:
        return {}
    seen: Counter = Counter()
    for (text,) in docs.select("text").where(F.length("text") <= SAMPLE_CHARS).limit(sample_rows).collect():
        seen.update(_CUT.split(text)[1:])
    encode = _library(path)[0]
    return {x: len(encode(" " + x)) for x, _ in seen.most_common(keep)}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text).

    Counts are those of the tokenizer's library without special tokens added; a special token's
    string inside a text counts as its default has it. Null texts count as empty (0, 0, false);
    repeated rows are counted each; null doc_ids stay null; other columns are ignored; no rows
    give no rows. Texts of any length are counted whole.
    """
    path = path or default_vocabulary()
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_pieces(docs, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter2(path, "n", frequent.value)
        for b in batches:
            texts = b.column("text")
            n = [counter(x) if x else 0 for x in texts.to_pylist()]
            size = pa.compute.fill_null(pa.compute.binary_length(texts.cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
