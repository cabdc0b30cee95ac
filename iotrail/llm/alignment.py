"""Alignment of two tokenizers by galloping intersection of token ends.

A text with a blank in front is encoded twice: A by a byte-level BPE given as ranks, B by a SentencePiece model, which adds that blank
itself. Both cut the same bytes, so each is a rising list of end positions. The shorter list is looked up in the longer: from where an end
would lie if the other list were even, an exponential search brackets it and a binary search finds the first end not before it, for all
ends at once. Ends that are in both lists cut the text into groups; the ranks of neighbouring ends in the other list bound the tokens that
a token overlaps. A task works on some hundred thousand characters of texts together, whose positions follow each other.

The count of a pair of ids is the number of documents that link it anywhere. Tasks keep the distinct pairs of every document with their
number, in a written table; pairs are then counted by an ordinary aggregate. The highest count of an A id goes to the pairs as a broadcast
of at most one row per entry of A's vocabulary. Pairs with their counts go back to the documents as a broadcast up to ``BROADCAST`` pairs.
Beyond that, pairs that more than a ``SHARE``-th of all links name are broadcast (there are at most ``SHARE``), and the rest is joined over
an exchange, in which no key holds more than that.

Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros and an empty digest. Strings of
special tokens are plain text. Texts may be of any length: they are encoded in pieces of ``PIECE`` characters or more, cut before a blank
that stands between two other characters, where no token of either side can lie across. Repeated rows are documents of their own. An
empty table gives no rows; columns that are called like the new ones are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotrail.llm.common import drop_named, quoted
from iotrail.session import pin

#: How byte-level vocabularies of this family split text before merging (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in a row that the pattern is spared, as its look-ahead goes back one by one.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
PIECE = 100_000
#: Characters of texts that are aligned together, at least.
TOGETHER = 400_000
#: Distinct pairs with their counts that a broadcast may hold, some 100 bytes each.
BROADCAST = 1_000_000
SHARE = 1024
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
OUTPUT = (*COUNTS, "n_best", "count_sum", "groups_sha256")


class Sides:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, ranks: bytes, model: bytes):
        pairs = (line.split() for line in ranks.splitlines() if line)
        known = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=known, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = [b""] * (max(known.values(), default=-1) + 1)
        for token, rank in known.items():
            self.a_bytes[rank] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # No piece may hold a blank behind another character; else B is encoded whole.
        self.cut = re.compile(r"[^\s▁](?= [^\s▁])") if not any("▁" in p.lstrip("▁") for p in pieces) else None
        # Decimal ids with what follows them in the text of groups.
        self.a_text = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.b_text = [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]

    def pieces(self, text: str) -> list[str]:
        """The text cut before single blanks; the blanks that start the pieces but the first are theirs."""
        out, start = [], 0
        while self.cut and len(text) - start > 2 * PIECE:
            found = self.cut.search(text, start + PIECE)
            if found is None:
                break
            out.append(text[start : found.end()])
            start = found.end()
        return [*out, text[start:]]

    def a_ids(self, text: str) -> list[int]:
        """A's ids. White space in a row is a word but for its last character, which goes with what follows."""
        out, at = [], 0
        for run in LONG_BLANK.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.a.encode_ordinary(text[at : run.start()])
            out += self.a._encode_single_piece(text[run.start() : end])
            at = end
        return out + self.a.encode_ordinary(text[at:] if at else text)

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of both sides; none if either does not give the text back."""
        if not text:
            return [], []
        a, b = [], []
        for k, piece in enumerate(self.pieces(text)):
            a += self.a_ids(piece if k else " " + piece)
            b += self.b.encode(piece[1:] if k else piece)
        raw = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return [], []
        return a, b


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For every value of ``short``, the first place in ``long`` with a value not below it; ``guess`` is where each search begins.

    Both are rising. The distance from the guess doubles until the place is bracketed, then the bracket is halved; each step is done for
    all values that still need it.
    """
    n = len(long)
    rises = long[guess] < short
    low, high = np.where(rises, guess, -1), np.where(rises, n, guess)  # values at low are below, those at high are not
    open_, step = np.arange(len(short)), 1
    while len(open_):
        up = rises[open_]
        probe = guess[open_] + np.where(up, step, -step)
        inside = (probe >= 0) & (probe < n)
        open_, up, probe = open_[inside], up[inside], probe[inside]
        below = long[probe] < short[open_]
        low[open_[below]], high[open_[~below]] = probe[below], probe[~below]
        open_, step = open_[below == up], step * 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        below = long[middle] < short[open_]
        low[open_[below]], high[open_[~below]] = middle[below], middle[~below]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def align(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two rising lists of ends whose last ends agree: the places of the common ends in either, and for every token of ``short`` the first
    token of ``long`` that overlaps it and the one behind the last."""
    at = gallop(short, long, guess)
    same = long[at] == short
    first = np.append(0, (at + same)[:-1])
    return np.flatnonzero(same), at[same], first, at + 1


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(counts))


def _rows(sides: Sides, texts: list[str | None], text_too: bool) -> list[pa.Array]:
    """``COUNTS``, the digest, the text of groups if asked for, and the distinct pairs of every text, as arrow columns."""
    every = [sides.tokens(t) for t in texts]
    n_a, n_b = (np.array([len(t[k]) for t in every], np.int64) for k in (0, 1))
    n_groups, n_links = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    digests, shown = [""] * len(texts), [""] * len(texts)
    codes, of_doc, times = [], [], []
    # Texts whose B list is the shorter one take the other role.
    for swap in (False, True):
        docs = np.flatnonzero((n_a > 0) & ((n_b < n_a) == swap))
        if not len(docs):
            continue
        a, b = (np.fromiter((i for d in docs.tolist() for i in every[d][k]), np.int64, int(n[docs].sum())) for k, n in ((0, n_a), (1, n_b)))
        ends_a, ends_b = np.cumsum(sides.a_length[a]), np.cumsum(sides.b_length[b])
        (short, m), (long, n) = ((ends_b, n_b[docs]), (ends_a, n_a[docs])) if swap else ((ends_a, n_a[docs]), (ends_b, n_b[docs]))
        doc = np.repeat(np.arange(len(docs)), m)  # of each token of the shorter list
        rank = np.arange(len(short)) - _starts(m)[doc]
        cut_s, cut_l, first, behind = align(short, long, _starts(n)[doc] + rank * n[doc] // m[doc])
        n_groups[docs] = np.bincount(doc[cut_s], minlength=len(docs))
        overlaps = behind - first
        n_links[docs] = np.bincount(doc, overlaps, len(docs)).astype(np.int64)
        # Links: every token of the shorter list with its range in the other.
        s = np.repeat(np.arange(len(short)), overlaps)
        l = np.arange(len(s)) - np.repeat(_starts(overlaps)[:-1] - first, overlaps)  # noqa: E741
        a_at, b_at = (l, s) if swap else (s, l)
        width = len(sides.b_bytes)
        code, number = np.unique((doc[s] * len(sides.a_bytes) + a[a_at]) * width + b[b_at], return_counts=True)
        rest, b_id = np.divmod(code, width)
        which, a_id = np.divmod(rest, len(sides.a_bytes))
        codes.append(a_id << 32 | b_id)
        of_doc.append(docs[which])
        times.append(number)
        # The text of groups: A's ids, then B's, group by group. An id that ends a group is followed by another sign.
        cut_a, cut_b = (cut_l, cut_s) if swap else (cut_s, cut_l)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a], last_b[cut_b] = 1, 1
        group_a, group_b = np.append(0, np.cumsum(last_a)[:-1]), np.append(0, np.cumsum(last_b)[:-1])
        order = np.empty(len(a) + len(b), np.int64)
        before_b, before_a = np.append(0, cut_b + 1), np.append(0, cut_a + 1)
        order[np.arange(len(a)) + before_b[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + before_a[group_b + 1]] = 2 * b + last_b + 2 * len(sides.a_bytes)
        words, ends = sides.a_text + sides.b_text, _starts(n_a[docs] + n_b[docs]).tolist()
        order = order.tolist()
        for k, d in enumerate(docs.tolist()):
            text = "".join(map(words.__getitem__, order[ends[k] : ends[k + 1]]))[:-1]
            digests[d] = hashlib.sha256(text.encode()).hexdigest()
            if text_too:
                shown[d] = text
    code, d, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, of_doc, times))
    by = np.argsort(d, kind="stable")
    cells = pa.StructArray.from_arrays([pa.array(code[by]), pa.array(number[by].astype(np.int32))], names=["pair", "times"])
    pairs = pa.ListArray.from_arrays(pa.array(_starts(np.bincount(d, minlength=len(texts))), pa.int32()), cells)
    return [*(pa.array(c) for c in (n_a, n_b, n_groups, n_links)), pa.array(digests), *([pa.array(shown)] if text_too else []), pairs]


_ready: dict[bytes, Sides] = {}


def _sides(ranks: bytes, model: bytes) -> Sides:
    """One pair of tokenizers in each Python worker."""
    key = hashlib.md5(ranks + model).digest()
    if key not in _ready:
        _ready.clear()
        _ready[key] = Sides(ranks, model)
    return _ready[key]


def groups(docs: DataFrame, ranks: str, model: str, text: str = "text", carry: list[str] | None = None, shown: str | None = None) -> DataFrame:
    """The carried columns of every document with ``COUNTS``, ``groups_sha256``, and ``links`` (its distinct pairs, ``a_id << 32 | b_id``, and how
    often it has each). ``shown`` names a column for the groups themselves, as text: ``a1,a2|b1;a3|b2,b3``.
    """
    files = []
    for path in (ranks, model):
        with open(path, "rb") as file:
            files.append(file.read())
    raw = docs.sparkSession.sparkContext.broadcast(files)  # two vocabulary files, 1 MB here
    new = [*COUNTS, "groups_sha256", *([shown] if shown else []), "links"]
    kept = drop_named(docs.select(*map(quoted, docs.columns if carry is None else carry)), [*new, *OUTPUT]).columns
    given = docs.select(*map(quoted, kept), quoted(text).alias("text of the operator"))
    link = T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.IntegerType())])
    kinds = [T.LongType()] * len(COUNTS) + [T.StringType()] * (1 + bool(shown)) + [T.ArrayType(link)]
    schema = T.StructType([*given.schema.fields[:-1], *(T.StructField(c, k) for c, k in zip(new, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*raw.value)
        for batch in batches:
            start, size = 0, 0
            texts: list[str | None] = []
            for row in range(batch.num_rows):
                texts.append(batch.column(batch.num_columns - 1)[row].as_py())
                size += len(texts[-1] or "") + 1
                if size >= TOGETHER or row == batch.num_rows - 1:
                    part = batch.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_rows(sides, texts, bool(shown))], names=[*kept, *new])
                    start, size, texts = row + 1, 0, []

    return given.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair`` and ``count`` (documents that link it), and whether that is the highest count of its A id (``best``)."""
    counts = pin(aligned.selectExpr("inline(links)").groupBy("pair").agg(F.count(F.lit(1)).alias("count")))
    a_id = F.shiftright("pair", 32)
    tops = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("top"))  # one row per entry of A's vocabulary at most
    return counts.withColumn("a_id", a_id).join(F.broadcast(tops), "a_id").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def scored(aligned: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """``groups`` with ``n_best`` and ``count_sum`` over the links of every document, without ``links``."""
    rows = pin(aligned.withColumn("row of the operator", F.monotonically_increasing_id()))
    key = "row of the operator"
    pairs = pin(pair_counts(rows))
    links = rows.selectExpr(f"`{key}`", "inline(links)")
    size = pairs.agg(F.count(F.lit(1)), F.sum("count")).first()
    if size[0] <= broadcast:
        found = links.join(F.broadcast(pairs), "pair")
    else:
        often = F.col("count") * SHARE > (size[1] or 0)
        hot = links.join(F.broadcast(pairs.where(often)), "pair", "left")
        cold = hot.where("count is null").drop("count", "best").join(pairs.where(~often), "pair")
        found = hot.where("count is not null").unionByName(cold)
    sums = found.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = rows.drop("links").join(sums, key, "left").drop(key)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
