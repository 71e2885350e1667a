"""Text forms of entries, vectors and settings, and what is written as text."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import entry_json
from tessera.functions.vectors import parse_csv


def parse_tokens(tokens: DataFrame, column: str = "token") -> DataFrame:
    """key, value of `key:value` tokens; the first colon splits, tokens without one are left out."""
    parts = F.split(F.col(column), ":", 2)
    return tokens.where(F.instr(column, ":") > 0).select(parts[0].alias("key"), parts[1].alias("value"))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """key, value of `key=value` lines, trimmed; lines without either are left out."""
    parts = F.split(F.col(column), "=", 2)
    pairs = lines.where(F.instr(column, "=") > 0).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))
    return pairs.where((F.length("key") > 0) & (F.length("value") > 0))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def vector_or_error(text: Column) -> Column:
    """The vector of a comma-joined text; anything else ends the query with an error."""
    found = parse_csv(text)
    return F.when(found.isNull(), F.raise_error(F.lit("INVALID_ARGUMENT: not a vector")).cast("array<float>")).otherwise(found)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def export_json(kv: DataFrame, path: str) -> None:
    """One JSON object a line and entry."""
    kv.select(entry_json(F.col("key"), F.col("value")).alias("value")).write.text(path)


@dataclass
class Settings:
    """Settings of a file of `name=value` lines; # starts a comment and unknown names are passed over."""

    server_host: str = "127.0.0.1"
    server_port: int = 8080
    server_enable_https: bool = False
    security_require_authentication: bool = True
    security_session_timeout_minutes: int = 30
    security_enable_audit_log: bool = True
    database_data_dir: str = "./_data"
    database_buffer_pool_size_mb: int = 4
    database_enable_compression: bool = False

    @classmethod
    def parse(cls, text: str) -> Settings:
        kinds = {f.name.replace("_", ".", 1): f for f in fields(cls)}
        found = {}
        for line in text.splitlines():
            name, cut, value = line.partition("=")
            if not cut or line.startswith("#") or name.strip() not in kinds:
                continue
            f, value = kinds[name.strip()], value.strip()
            found[f.name] = value in ("true", "1") if f.type == "bool" else int(value) if f.type == "int" else value
        return cls(**found)

    def text(self) -> str:
        show = {True: "true", False: "false"}
        return "".join(f"{f.name.replace('_', '.', 1)}={show.get(v, v) if isinstance(v := getattr(self, f.name), bool) else v}\n" for f in fields(self))

    @classmethod
    def development(cls) -> Settings:
        return cls(security_require_authentication=False, security_enable_audit_log=False, database_data_dir="./_dev_data")

    @classmethod
    def production(cls) -> Settings:
        return cls(server_host="0.0.0.0", server_port=443, server_enable_https=True)
