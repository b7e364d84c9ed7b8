"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

A merge-type (BPE) encoding is the one sequence of tokens whose neighbours are
all compatible: merging the characters of two neighbours together gives just
these two tokens again.  Hence the encoding of every prefix ends in one
definite token.  The encoder runs an automaton of all pieces over a chunk of
text, keeps for each prefix the one token that ends there and is compatible
with the last token of the prefix before it, and reads the ids backwards from
the end.

Text is cut into chunks only where no piece can reach across: before a space
mark that follows another character, and around a line break, if the model has
no piece with one.  Ids of chunks are kept in a bounded table.  Runs of space
marks, whose pieces share one score, are merged step by step instead, leftmost
first, as equal scores break the rule of the definite last token.

The plan is one map over the input.  Defined cases: a null or empty text gives
the end id alone; equal rows give equal values; a null id is carried; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
KEPT_CHUNKS = 300_000


class PieceEncoder:
    """Encodes and decodes as the sentencepiece library does with a BPE model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.get_piece_size() > 1 << 16:
            raise ValueError("pairs of pieces are numbers of 16 bits each")
        self.end = sp.eos_id()
        self.unknown = sp.unk_id()
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        reserved = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        ids = [i for i in range(sp.get_piece_size()) if not reserved(i)]
        self.piece = {i: sp.id_to_piece(i) for i in ids}
        self.rank = {p: (-sp.get_score(i), i) for i, p in self.piece.items()}
        self.by_bytes = all(sp.is_byte(i) for i in self.byte)
        odd = [p for p in self.rank if SPACE in p.lstrip(SPACE)]
        plain = all(sp.normalize(x) == SPACE + x.replace(" ", SPACE) for x in (" a  b ", "ﬁ　", "a\t\n"))
        if odd or not plain:
            raise ValueError("the model normalises text or has pieces with a space mark inside")
        self.chars = {p for p in self.rank if len(p) == 1}
        #: Pieces that encode to themselves; no other can be a token.
        self.automaton = ahocorasick.Automaton()
        for i, p in self.piece.items():
            if self.merge(p) == [i]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        line = "" if any("\n" in p for p in self.rank) else "\n"
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (f"|{line}+" if line else ""))
        self.length = {i: len(p) for i, p in self.piece.items()}
        self.decimal = [str(i) for i in range(sp.get_piece_size())]
        self.pairs: dict[int, bool] = {}  # by 65536 * left + right
        self.kept: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def merge_short(self, part: list[str]) -> list[str]:
        rank = self.rank
        while len(part) > 1:
            found = [rank.get(x + y) for x, y in zip(part, part[1:])]
            best = min((f for f in found if f), default=None)
            if best is None:
                break
            at = found.index(best)
            part[at : at + 2] = [part[at] + part[at + 1]]
        return part

    def merge(self, text: str) -> list[int | str]:
        """Ids by repeated merging of the best pair; characters without a piece stay characters."""
        if len(text) <= 24:
            return [self.rank[p][1] if p in self.rank else p for p in self.merge_short(list(text))]
        part: list[str | None] = list(text)
        after = list(range(1, len(part))) + [-1]
        before = list(range(-1, len(part) - 1))
        heap = []

        def offer(a, b):
            if a >= 0 and b >= 0 and (found := self.rank.get(part[a] + part[b])):
                heapq.heappush(heap, (found[0], a, b, len(part[a]), len(part[b])))

        for a in range(len(part) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, n, m = heapq.heappop(heap)
            if part[a] is None or part[b] is None or len(part[a]) != n or len(part[b]) != m or after[a] != b:
                continue
            part[a] += part[b]
            part[b] = None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [self.rank[p][1] if p in self.rank else p for p in part if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 16 | b)
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            left, right = self.piece[a], self.piece[b]
            if left + right in self.rank and self.merge(left + right) == [self.rank[left + right][1]]:
                known = False
            else:
                known = self.merge(left + right) == [a, b]
            self.pairs[a << 16 | b] = known
        return known

    def prefixes(self, text: str) -> list[int | str]:
        """Ids by the table of last tokens: entry ``i`` is of the prefix of ``i`` characters."""
        # -1: the start, or a character that no piece has; nothing merges across it.
        last: list = [-1, *[None if c in self.chars else -1 for c in text]]
        known, compatible = self.pairs.get, self.compatible
        for e, (token, n) in self.automaton.iter(text):
            if last[e + 1] is None:
                prior = last[e + 1 - n]
                if prior is not None and (
                    prior < 0 or (known(prior << 16 | token) or known(prior << 16 | token) is None and compatible(prior, token))
                ):
                    last[e + 1] = token
        out, e, piece = [], len(text), self.length
        while e:
            token = last[e]
            if token < 0:
                out.append(text[e - 1])
                e -= 1
            else:
                out.append(token)
                e -= piece[token]
        out.reverse()
        return out

    def chunk_ids(self, text: str) -> tuple[int, ...]:
        """Ids of a chunk; those of recent chunks are kept."""
        found = self.older.get(text)
        if found is None:
            found = self.merge(text) if SPACE * 2 in text else self.prefixes(text)
            if any(x.__class__ is str for x in found):
                found = self.spelled(found)
            found = tuple(found)
        if len(text) <= 64:
            if len(self.kept) >= KEPT_CHUNKS:
                self.older, self.kept = self.kept, {}
            self.kept[text] = found
        return found

    def spelled(self, tokens: list[int | str]) -> list[int]:
        """Characters that no piece has become ids of their bytes, or one unknown id."""
        ids: list[int] = []
        for x in tokens:
            if x.__class__ is int:
                ids.append(x)
            elif self.by_bytes:
                ids.extend(self.byte[b] for b in x.encode())
            elif ids[-1:] != [self.unknown]:
                ids.append(self.unknown)
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids, end id included."""
        if not text:
            return [self.end]
        kept, fresh = self.kept.get, self.chunk_ids
        ids = list(chain.from_iterable([kept(c) or fresh(c) for c in self.chunk.findall(SPACE + text.replace(" ", SPACE))]))
        ids.append(self.end)
        return ids

    def decimals(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    # The kept chunks are many small objects without cycles: collect seldom.
    gc.set_threshold(500_000, 20, 100)
    return PieceEncoder(path)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``ids`` and ``decoded`` of every row."""

    def run(batches):
        enc = piece_encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                decoded = [enc.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                    ["key", "ids", "decoded"],
                )

    given = df.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(run, "key long, ids array<int>, decoded string").withColumnRenamed("key", id_col)


def digest(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the number of ids, and digests of the ids and of the decoded text.

    Same ids as :func:`encode`; they stay in the task, as they take more room
    than the text.
    """

    def run(batches):
        enc = piece_encoder(model)
        sha = hashlib.sha256
        for batch in batches:
            keys, n, of_ids, of_text = [], [], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = enc.encode(text.as_py())
                keys.append(key.as_py())
                n.append(len(ids))
                of_ids.append(sha(enc.decimals(ids).encode()).hexdigest())
                of_text.append(sha(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    given = df.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return given.mapInArrow(run, kinds).withColumnRenamed("key", id_col)
