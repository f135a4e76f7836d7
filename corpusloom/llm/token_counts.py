"""Token counts without tokenising what is one token anyway.

A sentencepiece BPE vocabulary in which no piece has a word mark after any other
character can be counted word by word: a merge never crosses the start of a word
mark run.  ``WholeTokens`` proves that from the vocabulary, along with which
pieces encode alone as exactly one token; such words count one by a look-up and
only the rest is merged by the library.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import column_udf, load, ship

MARK = "▁"
MEMO_WORDS = 400_000
MEMO_WORD_CHARS = 64


def _marked(library: object, text: str) -> list[str]:
    """The pieces of a text whose words are encoded one after another with their marks."""
    out: list[str] = []
    for part in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)):
        out += library.encode(part[1:], out_type=str) if len(part) > 1 else [MARK]
    return out


def _library(model: bytes) -> object:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def prove(model: bytes) -> tuple[bool, bool, list[str]]:
    """What the vocabulary of a sentencepiece BPE model (given as bytes) allows: whether words can be counted apart, whether a line feed ends them, and the words that are one token alone."""
    sp = _library(model)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    #: What the shortcut rests on; where it doesn't hold, every text goes through the library whole.
    proven = (
        not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain)
        and [sp.encode(t, out_type=str) for t in ("", "a  b ", "ﬁ")] == [[], *(_marked(sp, t) for t in ("a  b ", "ﬁ"))]
    )
    #: A line feed is in no piece, so it ends words too and is a token of its own.
    feed = proven and not any("\n" in p for p in plain) and len(sp.encode("\n")) == 2
    starting = [p for p in plain if p[0] == MARK and MARK not in p[1:] and len(p) > 1]
    encoded = sp.encode([p[1:] for p in starting])
    return proven, feed, [p[1:] for p, ids in zip(starting, encoded, strict=True) if len(ids) == 1]


class WholeTokens:
    """Counts the tokens of texts under a sentencepiece BPE model given as bytes, by what ``prove`` tells of it."""

    def __init__(self, model: bytes, proof: tuple[bool, bool, list[str]] | None = None) -> None:
        self.library = _library(model)
        self.proven, self.feed, whole = proof or prove(model)
        self.whole = dict.fromkeys(whole, 1)
        self.memo: dict[str, int] = {}
        self.after: dict[str, int] = {}

    def _merge(self, words: set[str], memo: dict[str, int], lead: str) -> None:
        extra = len(self.library.encode(lead)) if lead else 0
        if len(memo) > MEMO_WORDS:
            memo.clear()
        todo = list(words)
        for w, ids in zip(todo, self.library.encode([lead + w for w in todo], num_threads=1), strict=True):
            memo[w] = len(ids) - extra

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.proven:
            return len(self.library.encode(text))
        text = text.replace(MARK, " ")
        total = 0
        marked: list[str] = []
        if self.feed and "\n" in text:
            first, *rest = text.split("\n")
            total += len(rest)
            heads = []
            for line in rest:
                if line:
                    head, gap, tail = line.partition(" ")
                    if head:
                        heads.append(head)
                    if gap:
                        marked += tail.split(" ")
            total += self._sum(heads, self.after, "\n")
            marked += first.split(" ")
        else:
            marked = text.split(" ")
        if "" in marked:  # runs of spaces belong to the next word
            marked = self._runs(text)
        return total + self._sum(marked, self.memo, "")

    def _runs(self, text: str) -> list[str]:
        """The words of a text after their first mark, further marks kept."""
        out = []
        for n, line in enumerate(text.split("\n") if self.feed else [text]):
            if n:
                line = line[len(line.split(" ", 1)[0]) :]
                if not line:
                    continue
                out += [p[1:] for p in re.findall(" +[^ ]*", line)]
            else:
                out += [p[1:] for p in re.findall(" +[^ ]*", " " + line)]
        return out

    def _sum(self, words: list[str], memo: dict[str, int], lead: str) -> int:
        whole = self.whole if not lead else {}
        counts = [whole.get(w) or memo.get(w) for w in words] if whole else [memo.get(w) for w in words]
        if None in counts:
            missing = {w for w, c in zip(words, counts, strict=True) if c is None}
            found: dict[str, int] = {}
            short = {w for w in missing if len(w) <= MEMO_WORD_CHARS and w}
            if short:
                self._merge(short, memo, lead)
            for w in missing - short:
                found[w] = len(self.library.encode(lead + w)) - (len(self.library.encode(lead)) if lead else 0) if w or lead else 1
            counts = [c if c is not None else memo[w] if w in short else found[w] for w, c in zip(words, counts, strict=True)]
        return sum(counts)


@functools.lru_cache(maxsize=4)
def _proof(proto: bytes) -> tuple[bool, bool, list[str]]:
    return prove(proto)


def _with_proof(model: str) -> tuple[bytes, tuple[bool, bool, list[str]]]:
    with open(model, "rb") as f:
        proto = f.read()
    return proto, _proof(proto)


def count_tokens(docs: DataFrame, model: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with a column of token counts (long), row by row, without a shuffle.

    A null or empty text counts 0.  Any other columns, repeated rows and empty tables pass through;
    a column that is already called ``into`` is replaced.  Texts are read whole.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(_with_proof(model))  # one vocabulary file and its words

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = WholeTokens(*sent.value)
        for batch in batches:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    return docs.withColumn(into, column_udf("long", counts)(F.col(text)))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return count_tokens(docs, default_model()).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit")
    )
