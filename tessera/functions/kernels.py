"""The kernels as SQL functions over Arrow batches. Rows with a null argument give null.

Functions named try_* return a struct of the result and the error's kind instead of failing the query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from tessera.kernels import bsdiff, containers, dcm, delta, hashes, lzms, manifests, pa19, pe, reversal, xpress

HEADER = (
    "struct<version:string,file_time:decimal(20,0),file_type_set:bigint,file_type:bigint,flags:bigint,target_size:bigint,"
    "hash_algorithm:int,target_hash:binary,extra:struct<field1:int,field2:int,field3:int,extra_hash:binary>>"
)
OLD_HEADER = "struct<flags:bigint,old_size:bigint,old_crc:bigint,new_size:bigint,new_crc:bigint,window:bigint,interleave:bigint,data_start:bigint>"


@lru_cache(maxsize=64)
def _arrow(ddl: str) -> pa.DataType:
    return to_arrow_type(_parse_datatype_string(ddl))


def _each(arrays: tuple[pa.Array, ...], f: Callable, kind: pa.DataType) -> pa.Array:
    rows = zip(*(a.to_pylist() for a in arrays), strict=True)
    return pa.array([None if None in row else f(*row) for row in rows], kind)


def function(f: Callable, ddl: str, arguments: int) -> Callable:
    """An Arrow function of one to four columns that calls f for each row."""
    kind = _arrow(ddl)  # on the driver: workers can't parse types
    if arguments == 1:

        @arrow_udf(ddl)
        def run(a: pa.Array) -> pa.Array:
            return _each((a,), f, kind)

    elif arguments == 2:

        @arrow_udf(ddl)
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return _each((a, b), f, kind)

    elif arguments == 3:

        @arrow_udf(ddl)
        def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return _each((a, b, c), f, kind)

    else:

        @arrow_udf(ddl)
        def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
            return _each((a, b, c, d), f, kind)

    return run


def attempt(f: Callable) -> Callable:
    """f's result, or the kind of what it raised."""

    def run(*arguments) -> dict:
        try:
            return {"result": f(*arguments), "error": None}
        except ValueError as error:
            return {"result": None, "error": getattr(error, "kind", None) or type(error).__name__}

    return run


# --- What the functions call --------------------------------------------------------------------------------


def _create(reference: bytes, target: bytes, version: str = "PA30", options: str = "") -> bytes:
    """options: words of md5, sha1, sha256, bsdiff, auto."""
    words = set(options.split())
    algorithm = next((n for w, n in (("md5", hashes.MD5), ("sha1", hashes.SHA1), ("sha256", hashes.SHA256)) if w in words), hashes.NONE)
    return delta.create(reference, target, delta.Options(version, algorithm, "bsdiff" if "bsdiff" in words else "lzx", "auto" if "auto" in words else "raw"))


def _header(data: bytes) -> dict:
    h = delta.header(data)
    extra = h.extra and dict(zip(("field1", "field2", "field3", "extra_hash"), h.extra, strict=True))
    return {
        "version": h.version, "file_time": h.file_time, "file_type_set": h.file_type_set, "file_type": h.file_type, "flags": h.flags,
        "target_size": h.target_size, "hash_algorithm": h.hash_algorithm, "target_hash": h.target_hash, "extra": extra,
    }


def _old_header(data: bytes) -> dict:
    h = pa19.parse(data)
    return vars(h) | {"data_start": h.data_start()}


def _reverse(reference: bytes, data: bytes) -> dict:
    target, back = delta.apply_and_reverse(reference, data)
    return {"target": target, "reverse": back}


#: Name, function, result type, arguments.
FUNCTIONS = (
    ("delta_create", lambda r, t: _create(r, t), "binary", 2),
    ("delta_create_with", _create, "binary", 4),
    ("delta_apply", delta.apply, "binary", 2),
    ("try_delta_apply", attempt(delta.apply), "struct<result:binary,error:string>", 2),
    ("try_delta_apply_into", attempt(delta.apply_into), "struct<result:binary,error:string>", 3),
    ("delta_apply_reverse", _reverse, "struct<target:binary,reverse:binary>", 2),
    ("delta_header", _header, HEADER, 1),
    ("try_delta_header", attempt(_header), f"struct<result:{HEADER},error:string>", 1),
    ("pa19_header", _old_header, OLD_HEADER, 1),
    ("reversal_apply", reversal.apply, "binary", 3),
    ("delta_signature", hashes.signature, "binary", 2),
    ("delta_normalise", pe.normalised, "binary", 1),
    ("dcm_strip", dcm.strip, "binary", 1),
    ("manifest_decompress", manifests.decompress, "binary", 2),
    ("manifest_base", manifests.extract_base, "binary", 1),
    ("lzms_compress", lzms.compress, "binary", 1),
    ("lzms_decompress", lzms.decompress, "binary", 2),
    ("lzms_expand", lambda d, n: containers.expand(d, n), "binary", 2),
    ("xpress_decompress", xpress.decompress, "binary", 2),
    ("container_write", lambda d, n: containers.write_container(d, n), "binary", 2),
    ("container_read", lambda d: containers.read_container(d), "binary", 1),
    ("wim_write", containers.write_wim, "binary", 2),
    ("wim_read", containers.read_wim, "binary", 3),
    ("wim_solid_write", containers.write_solid, "binary", 2),
    ("wim_solid_read", containers.read_solid, "binary", 1),
    ("wim_solid_range", containers.read_solid_range, "binary", 3),
    ("bsdiff_create", bsdiff.create, "binary", 2),
    ("bsdiff_patch", bsdiff.patch, "binary", 3),
)


@lru_cache(maxsize=1)
def functions() -> dict[str, Callable]:
    return {name: function(f, ddl, n) for name, f, ddl, n in FUNCTIONS}


def register(spark: SparkSession) -> None:
    """Make all functions callable from SQL by their names."""
    for name, f in functions().items():
        spark.udf.register(name, f)
