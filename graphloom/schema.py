"""The two relations of a graph and the tables beside them."""

from pyspark.sql import types as T

S, I, L = T.StringType(), T.IntegerType(), T.LongType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LOC = _struct(file=S, line=I, column=I)
NODES = _struct(id=S, kind=S, label=S, loc=LOC, tier=S, defines=T.ArrayType(S), refs=T.ArrayType(S), end_line=I, signature=S, decisions=I, measures=T.MapType(S, S))
EDGES = _struct(src=S, dst=S, kind=S, line=I, attrs=T.MapType(S, S))
DIAGNOSTICS = _struct(seq=L, kind=S, payload=S)
AUDIT = _struct(seq=L, ts=S, op=S, payload=S, prev_hash=S, hash=S)
ANNOTATIONS = _struct(id=L, target_id=S, body=S, ts=S)
META = _struct(key=S, value=S)
FILES = _struct(package=S, file=S, module_id=S, file_seq=L)
SYMBOLS = _struct(file_seq=L, sym_seq=I, package=S, file=S, module_id=S, id=S, kind=S, label=S, line=I, column=I, defines=T.ArrayType(S), refs=T.ArrayType(S), writes=T.ArrayType(S), end_line=I, signature=S, decisions=I, measures=T.MapType(S, S))
IMPORTS = _struct(file_seq=L, seq=I, from_module_id=S, to_module_id=S, bindings=T.ArrayType(S), line=I)
CALLS = _struct(file_seq=L, seq=I, from_id=S, to_name=S, line=I)
HERITAGE = _struct(file_seq=L, seq=I, type_name=S, target_name=S, kind=S, line=I)
TRANSACTIONS = _struct(tx_id=L, file=S)
CELLS = _struct(model=S, sheet=S, reference=S, row=I, column=I, formula=S, number=T.DoubleType(), text=S, cached=T.DoubleType(), number_format=S)
METERING = _struct(ts=S, key_id=S, plan=S, method=S, path=S, status=I, response_bytes=L, duration_ms=L)
