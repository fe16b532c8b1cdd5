"""Title-anchored overlapping passages (O-22, O-23)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevia.functions.text import WHITE

#: Characters of a passage, characters shared with the next, passages of a document with its title.
SIZE, OVERLAP, MOST = 900, 150, 40


def passages(title: str, body: str) -> list[str]:
    """The title alone, then windows of the trimmed body under the title; a window ends at its last newline past its middle."""
    body, out, start = body.strip(WHITE), [title], 0
    while body and len(out) < MOST:
        end = min(start + SIZE, len(body))
        if end < len(body) and (newline := body.rfind("\n", start + SIZE // 2, end)) >= 0:
            end = newline
        if piece := body[start:end].strip(WHITE):
            out.append(f"{title}\n{piece}")
        if end >= len(body):
            break
        start = max(end - OVERLAP, start + 1)
    return out


#: Documents of which a task has the texts at once, characters of passages that it gives back at once.
ROWS, CHARS = 64, 1 << 20


def made(doc: list, ordinal: list, text: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ordinal, pa.int32()), pa.array(text, pa.string())], names=["doc", "ord", "text"])


def cut(batches):
    """Batches (doc, title, body) as batches (doc, ord, text) of about CHARS characters."""
    doc, ordinal, text, held = [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for i, title, body in zip(*(batch.slice(at, ROWS).column(k).to_pylist() for k in range(3))):
                own = passages(title or "", body or "")
                doc += [i] * len(own)
                ordinal += range(len(own))
                text += own
                held += sum(map(len, own))
                if held >= CHARS:
                    yield made(doc, ordinal, text)
                    doc, ordinal, text, held = [], [], [], 0
    if doc:
        yield made(doc, ordinal, text)


def chunk(docs: DataFrame, id_col: str = "doc", title_col: str = "title", text_col: str = "text") -> DataFrame:
    """(doc, ord, text): one row per passage; where a window begins hangs on the one before, so this is Python over Arrow batches."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc long, ord int, text string")
