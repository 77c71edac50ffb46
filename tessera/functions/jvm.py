"""The kernels' loops inside Spark's own processes: compiled by the compiler that Spark carries, sent along as a jar.

A session without such access (Spark Connect) has the Python functions only; the results are the same.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import lru_cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kernels import functions

#: Classes by the names of the Python functions whose results they give. Decoders leave rows over (null) that the Python function then takes.
ENCODERS = {
    "delta_create_with": "DeltaCreate", "lzms_compress": "LzmsCompress", "container_write": "ContainerWrite", "wim_write": "WimWrite",
    "wim_solid_write": "WimSolidWrite", "bsdiff_create": "BsdiffCreate",
}
DECODERS = {
    "delta_apply": "DeltaApply", "lzms_decompress": "LzmsDecompress", "container_read": "ContainerRead", "wim_read": "WimRead",
    "wim_solid_range": "WimSolidRange", "lzms_expand": "Expand", "bsdiff_patch": "BsdiffPatch",
}
#: Classes of this version are verified without stack frames, which the compiler gets wrong in long methods.
CLASS_VERSION = 49


@lru_cache(maxsize=4)
def _loader(context):
    """A class loader for the kernels out of a jar that tasks of this context have too."""
    jvm = context._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(files("tessera.jvm").joinpath("Kernels.java").read_text())
    classes = compiler.getBytecodes()
    with tempfile.NamedTemporaryFile(prefix="tessera-", suffix=".jar", delete=False) as out, zipfile.ZipFile(out, "w") as jar:
        for name in classes:
            data = bytearray(bytes(classes[name]))
            data[6:8] = CLASS_VERSION.to_bytes(2, "big")
            jar.writestr(f"{name.replace('.', '/')}.class", bytes(data))
    atexit.register(lambda: os.path.exists(out.name) and os.remove(out.name))
    context._jsc.addJar(out.name)
    urls = context._gateway.new_array(jvm.java.net.URL, 1)
    urls[0] = jvm.java.io.File(out.name).toURI().toURL()
    return jvm.java.net.URLClassLoader(urls, jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())


@lru_cache(maxsize=256)
def _function(context, name: str) -> Callable[..., Column]:
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    jvm, array = context._jvm, context._gateway.new_array

    def listed(kind, *items):
        found = array(kind, len(items))
        for k, item in enumerate(items):
            found[k] = item
        return found

    kind = _loader(context).loadClass(f"tessera.jvm.Kernels${name}")
    made = kind.getConstructor(listed(jvm.java.lang.Class)).newInstance(listed(jvm.java.lang.Object))
    class_of = jvm.org.apache.spark.util.Utils.classForName
    types = listed(jvm.java.lang.Class, kind.getInterfaces()[0], class_of("org.apache.spark.sql.types.DataType", True, False))
    maker = class_of("org.apache.spark.sql.functions", True, False).getMethod("udf", types)  # of several methods that would take it
    own = maker.invoke(None, listed(jvm.java.lang.Object, made, jvm.org.apache.spark.sql.types.DataTypes.BinaryType))
    return lambda *columns: Column(own.apply(_to_seq(context, list(columns), _to_java_column)))


def available(spark: SparkSession) -> bool:
    return hasattr(spark, "_jsparkSession")


def encoded(rows: DataFrame, column: str, name: str, *arguments: Column | str) -> DataFrame:
    """rows with a column of what an encoder makes."""
    if not available(rows.sparkSession):
        return rows.withColumn(column, functions()[name](*arguments))
    return rows.withColumn(column, _function(rows.sparkSession.sparkContext, ENCODERS[name])(*arguments))


def decoded(rows: DataFrame, column: str, name: str, *arguments: Column | str) -> DataFrame:
    """rows with a column of what a decoder makes; rows that are left over go to the Python function, which may fail on them."""
    if not available(rows.sparkSession):
        return rows.withColumn(column, functions()[name](*arguments))
    tried = rows.withColumn("_own", _function(rows.sparkSession.sparkContext, DECODERS[name])(*arguments))
    left = [F.when(F.col("_own").isNull(), F.col(a) if isinstance(a, str) else a) for a in arguments]
    return tried.withColumn(column, F.coalesce("_own", functions()[name](*left))).drop("_own")
