"""Operator 2, byte-pair encoding and decoding by tree concatenation.

A text is cut into segments at places where no token can span (before white space that
follows a visible character, around the special token), so that its ids are those of
the segments in order. Only unsplit text, a visible run longer than a segment, is cut
inside; its halves are encoded on their own, in parallel, and joined as a tree: at each join
a growing window of tokens on both sides is encoded anew, until its first and last token
are those the sides already had. Adjacent tokens that are the encoding of their
concatenation stay so in any longer text, hence agreement at both ends makes the joined
ids exactly those of the whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, query, read_table, worker_cached

SEGMENT_CHARS = 16384       # segment of a text; longer visible runs are halved down to this
LONG_CHARS = 1 << 16        # texts beyond this are encoded as rows of parts, not in one task
PART_CHARS = 1 << 15        # characters of such a part
SLICE_ROWS = 1_000          # texts whose ids a task holds at once

#: Splitting pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary_path() -> str:
    """Rank file of the vocabulary (the one of ``byte_bpe_50k.json``); a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Encoder and decoder over one rank file; built once a worker."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.base = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        n = max([*ranks.values(), *SPECIAL.values()]) + 1
        self.piece: list[bytes] = [b""] * n
        for b, i in ranks.items():
            self.piece[i] = b
        for s, i in SPECIAL.items():
            self.piece[i] = s.encode()
        self.digits = [str(i) for i in range(n)]
        self.special = regex.compile("(" + "|".join(map(regex.escape, SPECIAL)) + ")")

    @classmethod
    def of(cls, path: str) -> Codec:
        return worker_cached(("codec", path), lambda: cls(path))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, special tokens recognised."""
        if "<|" not in text and len(text) <= SEGMENT_CHARS:
            return self.base.encode_ordinary(text)
        ids: list[int] = []
        for part in self.special.split(text):
            if part in SPECIAL:
                ids.append(SPECIAL[part])
            elif part:
                for segment, whole in segments(part, SEGMENT_CHARS):
                    ids += self.base.encode_ordinary(segment) if whole else self.tree(segment)
        return ids

    def tree(self, run: str) -> list[int]:
        """Ids of unsplit text: halves, encoded on their own and joined."""
        if len(run) <= SEGMENT_CHARS:
            return self.base.encode_ordinary(run)
        mid = len(run) // 2
        return self.join(self.tree(run[:mid]), self.tree(run[mid:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the text of ``left`` followed by that of ``right``, both ids of visible text."""
        k = 8
        while left and right:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self._text(left[a:] + right[:b])
            if window is not None:
                ids = self.base.encode_ordinary(window)
                first = a == 0 or (ids[0] == left[a] and window[0] != "'")
                last = b == len(right) or (ids[-1] == right[b - 1] and "'" not in window[-3:])
                if first and last:
                    return left[:a] + ids + right[b:]
            if a == 0 and b == len(right):
                break       # nothing left to grow by; only ill-formed bytes come here
            k *= 2
        return left + right

    def _text(self, ids: list[int]) -> str | None:
        """Text of the ids, None where they begin or end inside a character."""
        try:
            return b"".join([self.piece[i] for i in ids]).decode()
        except UnicodeDecodeError:
            return None

    def decode(self, ids: list[int]) -> str:
        piece = self.piece
        return b"".join([piece[i] for i in ids]).decode("utf-8", "replace")

    def digest(self, ids: list[int]) -> str:
        digits = self.digits
        return hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest()


_CUT = regex.compile(r"(?<=\S)(?=\s)")


def segments(text: str, most: int) -> Iterator[tuple[str, bool]]:
    """Parts of ``text`` of about ``most`` characters, cut only where a visible character is
    followed by white space. False marks a visible run longer than ``most`` (unsplit text)."""
    at, n = 0, len(text)
    while n - at > most:
        back = None
        for m in regex.finditer(r"(?r)(?<=\S)(?=\s)", text, pos=at + 1, endpos=at + most):
            back = m.start()
            break
        if back is None:     # no cut in reach: on to the next one
            m = _CUT.search(text, at + max(1, most - 1))
            end = m.start() if m else n
            yield from _unsplit(text[at:end], most)
            at = end
        else:
            yield text[at:back], True
            at = back
    if at < n:
        yield text[at:], True


def _unsplit(part: str, most: int) -> Iterator[tuple[str, bool]]:
    """White space before a long visible run goes on its own (up to its last character, which
    may belong to the run's first token), the run is marked."""
    lead = len(part) - len(part.lstrip())
    if lead > most or lead == len(part):
        yield part, True     # a long stretch of white space is one plain match
    else:
        yield part, False


def parts_of(codec: Codec, text: str, most: int) -> Iterator[tuple[str, bool]]:
    """Parts of a long text in order; True marks one that continues unsplit text, so that its
    ids must be joined with those before it rather than appended."""
    for piece in codec.special.split(text):
        if piece in SPECIAL:
            yield piece, False
            continue
        for segment, whole in segments(piece, most):
            cuts = range(0, len(segment), most) if not whole else [0]
            for k in cuts:
                yield (segment if whole else segment[k:k + most]), k > 0


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, keep_ids: bool = True,
                     keep_text: bool = False) -> DataFrame:
    """Append ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``
    (array<int>) and ``decoded`` to ``docs``.

    A null text counts as empty (no ids). Whole texts are encoded, special tokens in the text
    included; repeated rows get equal ids; input columns of the appended names are
    replaced; empty tables give empty results. Texts beyond ``LONG_CHARS`` are encoded once
    for each distinct text, as rows of parts over the cluster, and joined in order.
    """
    docs, vocab = bounded_batches(docs), path or vocabulary_path()
    fields = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    fields += ["ids array<int>"] * keep_ids + ["decoded string"] * keep_text
    names = [f.split()[0] for f in fields]

    def row_of(codec: Codec, ids: list[int]) -> list:
        back = codec.decode(ids)
        row = [len(ids), codec.digest(ids), hashlib.sha256(back.encode()).hexdigest()]
        # 4 bytes an id; a list would hold ten times that for all texts of a batch
        return row + [np.array(ids, np.int32)] * keep_ids + [back] * keep_text

    @F.pandas_udf(", ".join(fields))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(vocab)
        for texts in batches:
            for lo in range(0, len(texts), SLICE_ROWS):
                part = texts.iloc[lo:lo + SLICE_ROWS]
                yield pd.DataFrame([row_of(codec, codec.encode(t) if t else []) for t in part], columns=names)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(vocab)
        for b in batches:
            for key, whole_text in zip(b["key"], b["text"], strict=True):
                rows = [(key, k, p, more) for k, (p, more) in enumerate(parts_of(codec, whole_text, PART_CHARS)) if p]
                yield pd.DataFrame(rows, columns=["key", "part", "piece", "more"])

    @F.pandas_udf("array<int>")
    def encode_part(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec.of(vocab)
        for pieces in batches:
            yield pd.Series([np.array(codec.encode(p), np.int32) for p in pieces], dtype=object)

    def join_parts(group: pd.DataFrame) -> pd.DataFrame:
        """Ids of one text: unsplit stretches are joined as a tree, then all are appended."""
        codec, stretches = Codec.of(vocab), []
        for ids, more in group.sort_values("part")[["ids", "more"]].itertuples(index=False):
            if more:
                stretches[-1].append(ids.tolist())
            else:
                stretches.append([ids.tolist()])
        out: list[int] = []
        for level in stretches:
            while len(level) > 1:
                level = [codec.join(level[k], level[k + 1]) if k + 1 < len(level) else level[k]
                         for k in range(0, len(level), 2)]
            out += level[0]
        return pd.DataFrame([[group["key"].iloc[0], *row_of(codec, out)]], columns=["key", *names])

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    long = F.length(F.col(text)) > LONG_CHARS
    short = docs.where(~F.coalesce(long, F.lit(False))).withColumn("__llm_bpe", run.asNondeterministic()(F.col(text)))
    longer = docs.where(long).withColumn("__llm_key", F.sha2(F.col(text), 256))
    pieces = (longer.select(F.col("__llm_key").alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
              .mapInPandas(cut, "key string, part int, piece string, more boolean")
              .repartition("key", "part").select("key", "part", "more", encode_part("piece").alias("ids")))
    done = (pieces.groupBy("key").applyInPandas(join_parts, "key string, " + ", ".join(fields))
            .withColumnRenamed("key", "__llm_key"))
    done = done.select("__llm_key", F.struct(*names).alias("__llm_bpe"))
    both = short.select(*rest, "__llm_bpe.*")
    return both.unionByName(longer.join(done, "__llm_key").select(*rest, "__llm_bpe.*"))


@query("op2_bpe_tree")
def op2_bpe_tree(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, keep_ids=False).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: one row a document with its token ids and digests."""
    out = encode_documents(docs.select("doc_id", F.col("text")))
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")
