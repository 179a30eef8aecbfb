"""Graph tables: node and edge layouts, labels, edge types and thresholds."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODES = _struct(
    id=_S, label=_S, name=_S, filePath=_S, startLine=_I, endLine=_I, isExported=_B, content=_S,
    language=_S, parameterCount=_I, returnType=_S, ownerId=_S, visibility=_S, props=T.MapType(_S, _S),
)
EDGES = _struct(id=_S, src=_S, dst=_S, type=_S, confidence=_D, reason=_S, step=_I)
EMBEDDINGS = _struct(nodeId=_S, embedding=T.ArrayType(T.FloatType()))
CONTRACTS = _struct(
    repo=_S, contractId=_S, type=_S, role=_S, symbolUid=_S, filePath=_S, symbolName=_S, confidence=_D, service=_S, meta=T.MapType(_S, _S)
)

SYMBOL_LABELS = ("Class", "Function", "Interface", "Method")
CLUSTER_EDGES = ("CALLS", "EXTENDS", "IMPLEMENTS")
EMBEDDABLE = ("Class", "File", "Function", "Interface", "Method")

#: Confidence of a resolution tier.
TIER_CONFIDENCE = {"same-file": 0.95, "import": 0.9, "global": 0.5}
#: Confidence of an edge in impact analysis, where it has none; others 0.5.
IMPACT_FLOOR = {
    **dict.fromkeys(["CONTAINS", "HAS_METHOD", "HAS_PROPERTY"], 0.95),
    **dict.fromkeys(["CALLS", "IMPORTS"], 0.9),
    **dict.fromkeys(["EXTENDS", "IMPLEMENTS", "METHOD_IMPLEMENTS", "METHOD_OVERRIDES"], 0.85),
    "ACCESSES": 0.8,
}
IMPACT_TYPES = ("CALLS", "EXTENDS", "HAS_METHOD", "HAS_PROPERTY", "IMPLEMENTS", "IMPORTS", "METHOD_OVERRIDES")

MAX_FILE_BYTES = 512 * 1024
TRACE_MIN_CONFIDENCE, TRACE_BRANCH, TRACE_DEPTH, TRACE_MIN_STEPS, TRACES_PER_ENTRY = 0.5, 4, 10, 3, 12
ENTRY_POINTS, PROCESSES_MIN, PROCESSES_MAX = 200, 20, 300
LARGE_GRAPH = 10_000
RRF_K = 60
