"""Bytes from and to processes and sockets."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def command(words: list[str], data: bytes = b"", timeout: float | None = None) -> tuple[int, bytes, bytes]:
    """Run a process on the driver: exit code, output, errors."""
    done = subprocess.run(words, input=data, capture_output=True, timeout=timeout, check=False)
    return done.returncode, done.stdout, done.stderr


def pipe(lines: DataFrame, words: str) -> DataFrame:
    """Each partition's lines (first column) through a process on its executor; its output lines."""
    out = lines.rdd.map(lambda r: "" if r[0] is None else str(r[0])).pipe(words, checkCode=True)
    return lines.sparkSession.createDataFrame(out.map(lambda x: (x,)), "line string")


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a socket as a stream; for tests, since a socket cannot be read again."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()
