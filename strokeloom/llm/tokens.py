"""Unigram token counts with a trie shared by pre-tokens.

A text is cut before every space; a pre-token is the piece with its space written as the mark
U+2581 (one stands before the text, too). Its count is the number of pieces on the best path of the
unigram lattice: the path with the largest sum of piece scores. The best score of a prefix depends
on the prefix alone, so the distinct pre-tokens are put into a trie (walked in sorted order, with
the path from the root on a stack) and each node's score is computed once for all pre-tokens below
it; terminal nodes store counts. Each task keeps the counts of pre-tokens met before, up to a
bound, so no words are shuffled.

The scores are a Zipf prior over the vocabulary's order: minus the logarithm of a piece's place. A
character that no piece covers costs UNKNOWN less than the worst piece and is as many tokens as it
has UTF-8 bytes.

Defined cases: null and empty texts have 0 tokens; on equal scores the path with fewer tokens wins;
pre-tokens of any length, and very long texts, take time in proportion to it; rows that repeat stay
rows; an empty table gives no rows; extra columns pass by untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strokeloom.llm.common import documents

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
KNOWN = 1 << 18  # pre-tokens whose counts a task keeps
LONGEST_KNOWN = 64  # longer ones are counted and forgotten


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(k) for k in ids if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]


def scores_of(pieces: list[str]) -> dict[str, float]:
    return {p: -math.log(k + 2) for k, p in enumerate(pieces)}


class Forward:
    """Best path counts of pre-tokens under a unigram vocabulary."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        lengths: dict[str, set] = {}
        for p in scores:
            lengths.setdefault(p[-1], set()).add(len(p))
        #: A node looks back by the lengths of pieces that end in its letter.
        self.lengths = {c: sorted(x) for c, x in lengths.items()}
        self.worst = min(scores.values(), default=0.0) - UNKNOWN

    def counts(self, pretokens: list[str]) -> dict[str, int]:
        """Walks the trie of pretokens in sorted order; the stack holds one node for each letter."""
        best, tokens, out, before = [0.0], [0], {}, ""
        get, lengths, worst = self.scores.get, self.lengths, self.worst
        for word in sorted(pretokens):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for at in range(shared, len(word)):
                end, c = at + 1, word[at]
                top, n = best[at] + worst, tokens[at] + len(c.encode("utf-8", "surrogatepass"))
                for k in lengths.get(c, ()):
                    if k > end:
                        break
                    s = get(word[end - k : end])
                    if s is not None:
                        if k == 1:
                            top, n = best[at] + s, tokens[at] + 1
                            continue
                        s += best[end - k]
                        m = tokens[end - k] + 1
                        if s > top or (s == top and m < n):
                            top, n = s, m
                best.append(top)
                tokens.append(n)
            out[word] = tokens[len(word)]
            before = word
        return out


class TextCounter:
    """Token counts of texts, with the counts of pre-tokens met before."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.forward, self.known = Forward(scores), {}

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [Counter(t.split(" ")) if t else None for t in texts]
        fresh = {w for c in cut if c for w in c if w not in self.known}
        if len(self.known) + len(fresh) > KNOWN:
            self.known = {}
            fresh = {w for c in cut if c for w in c}
        self.known.update((w[1:], n) for w, n in self.forward.counts([MARK + w for w in fresh]).items())
        out = [sum(n * self.known[w] for w, n in c.items()) if c else 0 for c in cut]
        for w in fresh:
            if len(w) > LONGEST_KNOWN:
                del self.known[w]
        return out


def with_token_counts(docs: DataFrame, pieces: list[str], text: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs and a column of token counts."""
    shared = docs.sparkSession.sparkContext.broadcast(scores_of(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TextCounter(shared.value)
        for batch in batches:
            column, out = batch.column(batch.schema.get_field_index(text)), []
            for at in range(0, len(column), 512):
                out += counter.count(column.slice(at, 512).to_pylist())
            yield batch.append_column(name, pa.array(out, pa.int64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = with_token_counts(docs, read_pieces(vocabulary))
    return counted.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_tokens")
