"""Operator 2: SentencePiece encoding and decoding of whole texts with a distinct-chunk table (see pieces.py).

One pass over the documents without any shuffle. Ids leave as little-endian unsigned 32-bit integers in a binary column; decoding is the
library's decode(ids) for each document.

Defined cases: a null text counts as empty; an empty text has only the begin and end ids and decodes to the empty text;
repeated rows give repeated results; a null id is kept; an empty table gives an empty result; other columns of the input pass
only if the caller names them in `keep`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import broadcast_file, map_arrow
from ebbtide.llm.pieces import table_for


def encode_pieces(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and on request ids (binary, <u4) and decoded (string)."""
    proto = broadcast_file(docs.sparkSession, model_path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_decoded

    def make():
        table = table_for(proto.value)
        m = table.model
        begin, end = np.array([m.bos], "<u4"), np.array([m.eos], "<u4")

        def run(b: pa.RecordBatch):
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out: list[list] = [[], [], [], [], []]
                for ids in table.encode(part.column(1).to_pylist()):
                    full = np.concatenate([begin, ids.astype("<u4"), end])
                    decoded = m.sp.decode(full.tolist())
                    raw = full.tobytes()
                    out[0].append(len(full))
                    out[1].append(hashlib.sha256(raw).hexdigest())
                    out[2].append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                    if with_ids:
                        out[3].append(raw)
                    if with_decoded:
                        out[4].append(decoded)
                cols = [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                cols += [pa.array(out[3], pa.binary())] * with_ids + [pa.array(out[4], pa.string())] * with_decoded
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_decoded
                yield pa.RecordBatch.from_arrays(cols, names)

        return run

    return map_arrow(docs.select(F.col(doc_id).cast("long"), F.col(text)), make, schema)


def decode_pieces(ids: DataFrame, model_path: str, doc_id: str = "doc_id", column: str = "ids") -> DataFrame:
    """doc_id and text from binary ids (<u4); null or empty ids decode to the empty text."""
    proto = broadcast_file(ids.sparkSession, model_path)

    def make():
        sp = table_for(proto.value).model.sp

        def run(b: pa.RecordBatch):
            texts = [sp.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return run

    return map_arrow(ids.select(F.col(doc_id).cast("long"), F.col(column)), make, "doc_id long, text string")
