"""Token counts of whole texts by a SentencePiece model, huge texts in overlapping chunks.

A text of more than `chunk_chars` characters is cut into chunks that overlap. Both encodings of an overlap are laid
over each other by character offsets, and spliced at a boundary that both have and that is proven stable: no piece of
the vocabulary holds the two characters beside it, so no merge can ever cross it and what stands left and right is
encoded independently. If an overlap has no such boundary, it is doubled, up to the rest of the text; so counts are
always those of the whole text. The memory of one encoding is bounded by the chunk unless a text has no stable
boundary at all.

Null or empty text: 0 bytes, 0 tokens. Very long texts are what the method is for; none is cut short. Repeated rows, and rows
of one doc_id or without one: a row each, so equal texts have equal counts. Of several stable boundaries in an overlap the
last is taken. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import common as C

CHUNK, OVERLAP, LIMIT = 20_000, 256, 4096
SPACE = "▁"


class Counter:
    def __init__(self, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        self.inside: set[str] = set()
        self.splices = self.widened = 0
        for i in range(self.sp.get_piece_size()):
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i)):
                p = self.sp.id_to_piece(i)
                self.inside.update(p[k : k + 2] for k in range(len(p) - 1))

    def ends(self, text: str) -> list[int]:
        """Offsets in text after each token."""
        pieces = self.sp.encode(text, return_type="proto", num_threads=1).pieces
        ends, at = [], 0
        for p in pieces:
            at += len(p.surface)
            ends.append(at)
        return ends

    def stable(self, text: str, at: int) -> bool:
        pair = text[at - 1 : at + 1].replace(" ", SPACE)
        return 0 < at < len(text) and pair not in self.inside

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if len(text) <= self.chunk + self.overlap:
            return len(self.sp.encode(text, num_threads=1))
        total, start = 0, 0
        while start < len(text):
            overlap = self.overlap
            while True:
                mid = start + self.chunk
                stop = min(len(text), mid + overlap)
                if stop == len(text):
                    return total + self.part(text, start, stop)[-1][1]
                left = self.part(text, start, stop)
                cut = self.splice(text, left, mid, stop)
                if cut:
                    break
                overlap *= 2
                self.widened += 1
            total += cut[1]
            start = cut[0]
            self.splices += 1
        return total

    def part(self, text: str, start: int, stop: int) -> list[tuple[int, int]]:
        """(offset in text, tokens from start to there) at token boundaries of text[start:stop].

        A chunk that does not begin the text gets the newline in front that no piece joins, whose tokens are taken off
        again: so the dummy prefix stands before the newline.
        """
        head = "" if start == 0 else "\n"
        ends = self.ends(head + text[start:stop])
        out: dict[int, int] = {}
        for n, e in enumerate(ends, 1):
            out.setdefault(e - len(head) + start, n)  # bytes of one character have no surface but the last
        skip = out.pop(start, 0) if head else 0
        return [(at, n - skip) for at, n in sorted(out.items()) if at > start]

    def splice(self, text: str, left: list[tuple[int, int]], mid: int, stop: int) -> tuple[int, int] | None:
        """The last boundary in the overlap that the next chunk's encoding shares and that is proven stable."""
        right = {at for at, _ in self.part(text, mid, stop)} | {mid}
        for at, n in reversed(left):
            if at < mid:
                return None
            if at in right and at < stop and self.stable(text, at):
                return at, n
        return None


def count_tokens(docs: DataFrame, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_file, chunk, overlap)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk + overlap]
            for i, ids in zip(short, counter.sp.encode([texts[i] for i in short], num_threads=1), strict=True):
                counts[i] = len(ids)
            for i in set(range(len(texts))) - set(short):
                counts[i] = counter.count(texts[i])
            yield pa.record_batch([b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    C.small_batches(docs.sparkSession)
    rows = C.first_with_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
