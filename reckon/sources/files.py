"""Files as relations: manifests, ZIP directories, JSON lines, rule configurations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bounds of a member of an archive, and of a rule configuration.
MOST_MEMBER_BYTES, MOST_RATIO = 512 * 1024 * 1024, 200.0
MOST_RULE_BYTES, MOST_RULE_DEPTH = 1024 * 1024, 32
MEMBER_SCHEMA = "archive string, member string, size_bytes long, compressed_bytes long, modified_at string, is_directory boolean, is_unsafe boolean, is_suspicious boolean"


def file_manifest(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """One row per file: path, filename, extension, size_bytes, modified_at. Contents are not opened.

    Any file system that Spark reads will do. Callers order by lower(path) for display.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(list(paths))
    name = F.regexp_replace("path", r"^.*[/\\]", "")
    return files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def unsafe_member(name: str) -> bool:
    """Absolute, drive-qualified, or climbing out of its folder."""
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or (len(parts[0]) == 2 and parts[0][1] == ":")


def repaired_name(name: str, flags: int) -> str:
    """A member name whose bytes were read as the old code page though they are UTF-8 or Cyrillic DOS."""
    if flags & 0x800:
        return name
    try:
        raw = name.encode("cp437")
    except UnicodeEncodeError:
        return name
    for code in ("utf-8", "cp866"):
        try:
            text = raw.decode(code)
        except UnicodeDecodeError:
            continue
        if any("а" <= c.lower() <= "я" or c in "ёЁ" for c in text):
            return text
    return name


MATERIAL = "path string, member string, size_bytes long, crc32 long, sha256 string, content binary, status string"


def materialized(spark: SparkSession, path: str, member: str | None = None, expected: tuple[int | None, int | None] = (None, None), most_bytes: int = MOST_MEMBER_BYTES) -> DataFrame:
    """One row: a bounded copy of a file, or of one member of a ZIP archive, whose size and check sum were looked at.

    expected: size and CRC-32 that a manifest names (None: not known). status: 'ok', 'too_large' (nothing is kept beyond the
    bound), 'not_found', 'unsafe', 'damaged' (the archive's own check sum does not hold) or 'changed' (not what is expected).
    Without 'ok' there is no content.
    """
    import hashlib
    import io
    import zipfile
    import zlib

    def copied(body: bytes) -> tuple[bytes | None, str]:
        if member is None:
            return (body, "ok") if len(body) <= most_bytes else (None, "too_large")
        if unsafe_member(member):
            return None, "unsafe"
        try:
            with zipfile.ZipFile(io.BytesIO(body)) as z:
                info = next((m for m in z.infolist() if repaired_name(m.filename, m.flag_bits) == member), None)
                if info is None:
                    return None, "not_found"
                with z.open(info) as f:  # the directory's size may lie, so the bound is on what comes out
                    out = f.read(most_bytes + 1)
                    return (out, "ok") if len(out) <= most_bytes else (None, "too_large")
        except (zipfile.BadZipFile, zlib.error, EOFError):
            return None, "damaged"

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, body in zip(b["path"], b["content"]):
                out, status = copied(bytes(body))
                size, crc = (len(out), zlib.crc32(out)) if out is not None else (None, None)
                if out is not None and any(want is not None and want != got for want, got in zip(expected, (size, crc))):
                    out, status = None, "changed"
                digest = hashlib.sha256(out).hexdigest() if out is not None else None
                row = pd.DataFrame([(at, member, size, crc, digest, out, status)], columns=[c.split()[0] for c in MATERIAL.split(", ")])
                yield row.astype({"size_bytes": "Int64", "crc32": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(copy, MATERIAL)


def zip_members(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per member of ZIP archives, from their directories alone; nothing is inflated.

    A broken archive fails its task with its path. is_suspicious: over the size or compression bound.
    """
    import io
    import zipfile

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, body in zip(b["path"], b["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    for m in z.infolist():
                        name = repaired_name(m.filename, m.flag_bits)
                        ratio = m.file_size / max(1, m.compress_size)
                        rows.append((path, name, m.file_size, m.compress_size, "%04d-%02d-%02dT%02d:%02d:%02d" % m.date_time, m.is_dir(), unsafe_member(name), m.file_size > MOST_MEMBER_BYTES or ratio > MOST_RATIO))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBER_SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInPandas(scan, MEMBER_SCHEMA)


def json_lines(spark: SparkSession, schema: StructType | str, *paths: str) -> DataFrame:
    """Strict JSON lines: a line that does not fit the schema fails the read; NaN and infinities are refused."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(list(paths))


def lenient_json_lines(spark: SparkSession, schema: str, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, lines that do not parse) of JSON lines."""
    lines = spark.read.text(list(paths)).select(F.col("value").alias("line"), F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = lines.filter("r._bad is null and trim(line) <> ''").select("r.*").drop("_bad")
    return good, lines.filter("r._bad is not null and trim(line) <> ''").select("line")


def blocked_keys(bad_lines: DataFrame, key_schema: str) -> DataFrame:
    """Keys that unusable lines still name, so that exactly those rows go to review."""
    names = [c.split()[0] for c in key_schema.split(", ")]
    return bad_lines.select(F.from_json("line", key_schema).alias("k")).filter(f"k.{names[0]} is not null").select("k.*").distinct()


def rule_configuration(text: str) -> object:
    """A rule file's payload: at most 1 MiB, 32 levels, no key twice. JSON, or YAML without anchors and tags if available."""
    if len(text.encode("utf-8")) > MOST_RULE_BYTES:
        raise ValueError("rule configuration is too large")

    def unique(pairs):
        keys = [k for k, _ in pairs]
        if len(keys) != len(set(keys)):
            raise ValueError("a key occurs twice")
        return dict(pairs)

    try:
        payload = json.loads(text, object_pairs_hook=unique)
    except json.JSONDecodeError:
        payload = _yaml(text)

    def depth(x) -> int:
        inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        return 1 + max(map(depth, inner), default=0)

    if depth(payload) > MOST_RULE_DEPTH:
        raise ValueError("rule configuration is too deep")
    return payload


def _yaml(text: str) -> object:
    try:
        import yaml
    except ImportError as error:
        raise ValueError("not JSON, and no YAML reader is installed") from error
    if any(isinstance(t, (yaml.AnchorToken, yaml.AliasToken, yaml.TagToken)) for t in yaml.scan(text)):
        raise ValueError("anchors, aliases and tags are not allowed")
    return yaml.safe_load(text)


def canonical_json(payload: object) -> str:
    return json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def content_digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, size_bytes, sha256) of whole files."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
