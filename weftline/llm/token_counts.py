"""Token counts with a whole-token shortcut, for sentencepiece BPE models.

Offline, once for a model: every vocabulary string that encodes alone as exactly one token is
found by encoding it. A text is cut where no vocabulary string has a character pair, so that no
merge can cross (proved on the vocabulary when the counter is built); a piece that is one of the
proved strings counts as one token, and only the rest is merged.

Defined cases: a null or empty text has 0 tokens; begin, end and added special tokens are never
counted; special strings in a text are ordinary text; texts are never cut short; repeated rows
count each for itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import table_path, with_columns

SPACE = "▁"
#: Merged pieces that one task remembers; then it starts anew.
MOST_REMEMBERED = 400_000
OVER = 4096
#: Runs of blanks with what follows them, or one line break. No merge crosses these cuts.
_PIECES = re.compile(r" *[^ \n]+| +|\n")


class PieceCounter:
    """Counts for one model file; build it once in each task."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.cuts_hold = not any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.single = self._prove(pieces)
        self.known: dict[str, int] = dict(self.single)

    def _prove(self, pieces: list[str]) -> dict[str, int]:
        """The strings, with blanks as in texts, that encode alone as one token."""
        # the model puts a blank before its input: strings with a leading blank are given without it
        led = [p for p in pieces if p[0] == SPACE and len(p) > 1]
        proved = {p.replace(SPACE, " "): 1 for p, ids in zip(led, self.model.encode([p[1:].replace(SPACE, " ") for p in led], num_threads=1), strict=True) if len(ids) == 1}
        # the others after a line break, which is a blank and a byte token of its own
        bare = [p for p in pieces if p[0] != SPACE]
        proved |= {p: 1 for p, ids in zip(bare, self.model.encode(["\n" + p for p in bare], num_threads=1), strict=True) if len(ids) - self._lead == 1}
        if SPACE in pieces:  # a blank alone: the model's own input prefix
            proved[" "] = 1
        return proved

    @property
    def _lead(self) -> int:
        return len(self.model.encode("\n"))

    def _merge(self, pieces: list[str]) -> None:
        """Count pieces that the shortcut does not know, by the model's merges, and remember them."""
        led = [p for p in pieces if p[0] == " "]
        bare = [p for p in pieces if p[0] != " "]
        lead = self._lead
        for own, made, less in ((led, [p[1:] for p in led], 0), (bare, ["\n" + p for p in bare], lead)):
            for p, ids in zip(own, self.model.encode(made, num_threads=1), strict=True):
                self.known[p] = len(ids) - less

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [_PIECES.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if not self.cuts_hold:
            return [len(ids) for ids in self.model.encode([t or "" for t in texts], num_threads=1)]
        new: set[str] = set()
        known = self.known
        for pieces in cut:
            new.update([p for p in pieces if p not in known])
        if new:
            if len(known) + len(new) > MOST_REMEMBERED + len(self.single):
                self.known = known = dict(self.single)
                new = set().union(*cut) - known.keys()
            self._merge(sorted(new))
        return [sum(map(known.__getitem__, pieces)) for pieces in cut]


def count_tokens(df: DataFrame, model_path: str, text: str = "text", names: tuple[str, str] = ("n_bytes", "n_tokens"), keep: list[str] | None = None) -> DataFrame:
    """``df`` with the UTF-8 bytes and the tokens of each text. ``model_path`` must be readable on every executor."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def make():
        counter = PieceCounter(model_path)

        def kernel(texts: pa.Array) -> list[pa.Array]:
            return [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(np.array(counter.count(texts.to_pylist()), np.int64))]

        return kernel

    return with_columns(df, text, schema, make, keep=keep)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table_path(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"]).withColumn("over_limit", F.col("n_tokens") > OVER)
