"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding. `Codec.last_tokens` stores that
token for each prefix: a candidate that ends at the prefix is right if it agrees with the last token of the prefix
before it, which `agrees` tells from the merges alone. Encodings then read off backwards, appends extend the table
exactly, and an edit needs the table only from the edited byte on.

The vocabulary is a rank file whose path is a parameter; each executor reads it once per Python worker. Pieces are
looked up in a bounded memo, so the programme runs once per distinct piece, not once per occurrence.

Edge cases: null text counts as empty (no tokens); texts are encoded whole, however long; repeated rows and extra
columns are left as they are; an empty table gives an empty result. Ids are checked by decoding to the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table

MEMO = 100_000


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.find = regex.compile(pattern).findall
        self.left_of, self.right_of = [0] * (max(self.bytes_of) + 1), [0] * (max(self.bytes_of) + 1)
        self.pairs: dict[int, int] = {}  # left << 24 | right -> the token they join to
        self.usable: dict[bytes, int] = {}  # tokens that merging can reach
        self.judged: dict[int, bool] = {}
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self._learn()
        self.ends = ahocorasick.Automaton()
        for token, rank in self.usable.items():
            self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()

    def _learn(self) -> None:
        """How each token comes from two lower ones. In order of rank, so that the halves are known already."""
        for rank in sorted(self.bytes_of):
            token = self.bytes_of[rank]
            if len(token) == 1:
                self.left_of[rank] = self.right_of[rank] = rank
                self.usable[token] = rank
                continue
            for cut in range(1, len(token)):
                left, right = self.usable.get(token[:cut]), self.usable.get(token[cut:])
                if left is not None and right is not None and self.agrees(left, right, rank):
                    self.left_of[rank], self.right_of[rank] = left, right
                    self.pairs[left << 24 | right] = rank
                    self.usable[token] = rank
                    break

    def agrees(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging leaves the border between the two tokens uncrossed. below: only merges of lower rank count."""
        limit = below if below is not None else 1 << 62
        pairs, left_of, right_of = self.pairs, self.left_of, self.right_of
        while True:
            joined = pairs.get(left << 24 | right)
            if joined is not None and joined < limit:
                return False
            # Take back the later of the two merges; the half at the border is what stood there before it.
            if left > right:
                limit, inner = left, right_of[left]
                if inner == left:
                    return True
                left = inner
            else:
                limit, inner = right + 1, left_of[right]
                if inner == right:
                    inner = right_of[left]
                    if inner == left:
                        return True
                    limit, left = left, inner
                else:
                    right = inner

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix's encoding. known: that of a prefix of `piece`, kept and extended."""
        last, judged, agrees = list(known or ()), self.judged, self.agrees
        done = len(last)
        # All tokens that end at each byte, the longest first. Bytes stand for the characters of the same number.
        for at, (size, rank) in self.ends.iter(piece.decode("latin-1")):
            if at < done:
                continue
            if at == size - 1:
                good = True
            else:
                pair = last[at - size] << 24 | rank
                good = judged.get(pair)
                if good is None:
                    good = agrees(last[at - size], rank)
                    if len(judged) < MEMO:
                        judged[pair] = good
            if good:
                last.append(rank)
                done = at + 1
        if done < len(piece):
            raise ValueError("the vocabulary lacks a byte")
        return last

    def read_off(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return ids[::-1]

    def edit(self, piece: bytes, last: list[int], at: int, new: bytes) -> tuple[list[int], list[int]]:
        """Encode `piece[:at] + new`, keeping the table of what stands before the edit."""
        table = self.last_tokens(piece[:at] + new, last[:at])
        return self.read_off(table), table

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.read_off(self.last_tokens(raw))

    def encode(self, text: str) -> list[int]:
        memo, ids = self.memo, []
        for piece in self.find(text):
            got = memo.get(piece)
            if got is None:
                got = self.older.get(piece)
                if got is None:
                    got = self.encode_piece(piece)
                if len(memo) >= MEMO:  # what is in use comes over from the older half
                    self.older, self.memo = memo, {}
                    memo = self.memo
                memo[piece] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_column(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id and n_tokens, with `ids` (array of int), or with digests of the ids and of the text decoded from them."""
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")

    def run(batches):
        own = codec(path, pattern)
        names = [str(i) for i in range(max(own.bytes_of) + 1)]
        for batch in batches:
            doc_ids, count, first, second = batch.column(0), [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                count.append(len(ids))
                if digests:
                    first.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                    second.append(hashlib.sha256(own.decode(ids)).hexdigest())
                else:
                    first.append(ids)
            columns = [doc_ids, pa.array(count, pa.int64())]
            columns += [pa.array(first, pa.string()), pa.array(second, pa.string())] if digests else [pa.array(first, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), schema)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), *vocabulary(), digests=True)
