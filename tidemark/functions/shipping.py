"""Making the package importable where Python tasks run."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import SparkSession

from .lineage import shared_folder

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Applications that have the package.
_SHIPPED: set[str] = set()


def archive() -> bytes:
    """The package's modules as a zip file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(PACKAGE_ROOT, __name__.split(".")[0])):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), PACKAGE_ROOT))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import the package: on this machine from where the driver did, on a cluster from an archive that Spark hands out."""
    context = spark.sparkContext
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])
    here = context.master == "local" or context.master.startswith("local[")
    if not here and context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tidemark-package-{uuid.uuid4().hex}.zip")
        stream = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path, True)
        try:
            stream.write(archive())
        finally:
            stream.close()
        context.addPyFile(path.toString())
