"""Cost-balanced packing of token sequences.

Every document is tokenised whole, an end id is appended, and all ids are laid
out in sequences of at most ``seq_len`` ids.  Blocks of ``seq_len`` ids of a
long document fill sequences of their own.  What remains of each document is
gathered, within its task, into groups of about ``group_tokens`` ids; a group
is packed by estimated cost: a piece of ``l`` ids costs
``linear * l + quadratic * l * l`` (projections grow with the length, attention
inside a document with its square), pieces go in descending cost to the
sequence of the lowest cost that still has room, and a piece that no sequence
can hold whole is cut.  A group has as many full sequences as its ids fill;
the ids left over go to sequences whose lengths are powers of two, so that
nothing is padded.

The plan is one map over the input: no shuffle, no driver state, and memory is
bounded by one group (of ``group_tokens`` ids or ``GROUP_PIECES`` remainders, whichever
comes first) and one Arrow batch.  A retried task repeats its result,
as a sequence id is made of the partition number and a running number.

Defined cases: a null or empty text is the end id alone; runs of white space of
any length are one token of the tokenizer's word pattern, as ``tokenizers`` has it; equal rows are packed
as separate documents; a null id is carried; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import handing_back

END_ID = 1
SEQ_LEN = 2048
GROUP_TOKENS = 1 << 21
GROUP_PIECES = 1 << 16
#: Runs of white space from here on are cut out: the merging library's pattern recurses once for each of their characters.
LONG_SPACE = 4096
_LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_SPACE)


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids, as ``tokenizers`` gives for the file at ``path``.

    The merges run in tiktoken, built from the same vocabulary, which is about
    ten times as fast.  Texts that hold the string of a special token, which
    ``tokenizers`` turns into that token, are left to ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    pre = spec["pre_tokenizer"]
    plain = (
        spec["normalizer"] is None
        and pre["type"] == "ByteLevel"
        and not pre["add_prefix_space"]
        and pre["use_regex"]
        and spec["model"]["type"] == "BPE"
        and not spec["model"]["ignore_merges"]
    )
    if not plain:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    # Byte-level vocabularies write the printable bytes as themselves and the
    # others, in order, as the code points from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {
        bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
    }
    words = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("packing", pat_str=words, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str):
        if any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        ids, at = [], 0
        for run in _LONG_SPACE.finditer(text) if len(text) >= LONG_SPACE else ():
            # The word pattern cuts before a run, and before its last character if a word follows.
            a, b = run.start(), run.end() - (run.end() < len(text))
            ids += fast.encode_ordinary(text[at:a]) + slow.encode(text[a:b], add_special_tokens=False).ids
            at = b
        return ids + fast.encode_ordinary(text[at:])

    return encode


def sequence_lengths(total: int, seq_len: int) -> list[int]:
    """Full sequences, then powers of two for the rest: no id is padded."""
    full, rest = divmod(total, seq_len)
    return [seq_len] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def balance(lengths: list[int], seq_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence), in the order in which sequences are filled.

    Open sequences wait in a heap by cost, those found too full for a piece in one by room.
    """
    room = sequence_lengths(sum(lengths), seq_len)
    cost = [0.0] * len(room)
    cheap = [(0.0, k) for k in range(len(room))]
    narrow: list[tuple[int, float, int]] = []
    out = []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[piece]
        while left:
            while narrow and -narrow[0][0] >= left:
                _, c, k = heapq.heappop(narrow)
                heapq.heappush(cheap, (c, k))
            while cheap and room[cheap[0][1]] < left:
                c, k = heapq.heappop(cheap)
                heapq.heappush(narrow, (-room[k], c, k))
            # Where none holds it whole, it is cut where the most goes in at once; of equals, at the lowest cost.
            to = heapq.heappop(cheap)[1] if cheap else heapq.heappop(narrow)[2]
            n = min(left, room[to])
            out.append((piece, start, n, to))
            room[to] -= n
            cost[to] += linear * n + quadratic * n * n
            if room[to]:
                heapq.heappush(cheap, (cost[to], to))
            start, left = start + n, left - n
    return out


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    end_id: int = END_ID,
    group_tokens: int = GROUP_TOKENS,
    linear: float = 1.0,
    quadratic: float = 1.0 / SEQ_LEN,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    Columns: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, unless switched off, ``ids``.
    """
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    fields += [("sequence_id", pa.int64()), ("offset", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema([("key", pa.int64()), *fields])

    def run(batches):
        encode = encoder(tokenizer)
        made = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def put(key, ids, start, total, sequence, offset):
            rows.append(
                (key, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, *[ids.astype("i4")] * with_ids)
            )

        def settle():
            nonlocal made, held
            filled: dict[int, int] = {}
            for i, start, n, to in balance([len(w[1]) for w in waiting], seq_len, linear, quadratic):
                key, ids, base, total = waiting[i]
                at = filled.get(to, 0)
                put(key, ids[start : start + n], base + start, total, made + to, at)
                filled[to] = at + n
                if len(rows) >= 4096:
                    yield flush()
            made += len(filled)
            waiting.clear()
            held = 0

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema
            )
            rows.clear()
            return out

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                ids = np.array([*encode(texts[i].as_py()), end_id], dtype="<u4")
                key, total = keys[i].as_py(), len(ids)
                whole = total - total % seq_len
                for start in range(0, whole, seq_len):
                    put(key, ids[start : start + seq_len], start, total, made, 0)
                    made += 1
                    if len(rows) >= 4096:
                        yield flush()
                if whole < total:
                    waiting.append((key, ids[whole:].copy(), whole, total))
                    held += total - whole
                if held >= group_tokens or len(waiting) >= GROUP_PIECES:
                    yield from settle()
                if len(rows) >= 4096:
                    yield flush()
        yield from settle()
        if rows:
            yield flush()
        # The process goes on with tasks of other steps, which have no use for the vocabulary.
        encoder.cache_clear()

    kinds = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    kinds += ", ids array<int>" * with_ids
    given = df.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(handing_back(run), kinds).withColumnRenamed("key", id_col)
