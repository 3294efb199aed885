"""Runs, locked tests and frozen declarations, kept as small files in a shared folder. Control plane: a handful of records, on the driver."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import time
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sealed import _file, create_once

# The fields of a run's record, those it must have, and how a locked test can end.
RUN_FIELDS = ("run_id", "spec_hash", "data_hash", "source_hash", "environment_hash", "event_ids", "seed", "metrics", "synthetic", "created_at")
REQUIRED = ("spec_hash", "data_hash", "source_hash", "environment_hash", "event_ids", "metrics", "synthetic")
ENDINGS = ("complete", "failed")


class RegistryConflict(ValueError):
    """A write that contradicts what is held."""


def canonical(value: object) -> str:
    """JSON with sorted keys and finite numbers; anything else raises."""
    return json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":"), allow_nan=False)


def _name(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


class RunRegistry:
    """Every fact is one file that is created exclusively and whole, which a shared file system decides for one writer only; no fact is overwritten."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, path: str) -> dict | None:
        fs, at = _file(self.spark, f"{self.root}/{path}")
        if not fs.exists(at):
            return None
        jvm = self.spark.sparkContext._jvm
        stream = fs.open(at)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, path: str, value: dict) -> bool:
        """False if the file was there already."""
        return create_once(self.spark, f"{self.root}/{path}", canonical(value).encode())

    def _delete(self, path: str) -> None:
        fs, at = _file(self.spark, f"{self.root}/{path}")
        fs.delete(at, False)

    def record_run(self, record: dict) -> str:
        """Stores a run; the same content again is no change, other content under the same id raises."""
        if unknown := sorted(set(record) - set(RUN_FIELDS)):
            raise ValueError(f"undeclared fields {unknown}")
        if absent := [f for f in REQUIRED if record.get(f) is None]:
            raise ValueError(f"missing fields {absent}")
        if len(set(record["event_ids"])) != len(record["event_ids"]) or not record["event_ids"]:
            raise ValueError("event_ids must be a set of at least one")
        record = record | {"event_ids": sorted(map(str, record["event_ids"])), "run_id": str(record.get("run_id") or uuid.uuid4().hex)}
        path = f"runs/{_name(record['run_id'])}.json"
        if not self._create(path, record):
            held = self._read(path)
            if {k: v for k, v in held.items() if k in record} != json.loads(canonical(record)):
                raise RegistryConflict(f"run {record['run_id']} is held with other content")
        return record["run_id"]

    def reserve(self, spec_hash: str, dataset_hash: str, event_ids: list[str], lease: float = 600.0) -> str:
        """A token for the one locked test of a specification. Events that another test claimed raise.

        The token's file is the commit: a claim counts only if its token has one, so that all of a test's claims come into force at once. Claims of a
        writer that broke off before it have no token and are taken over once they are older than the lease, in seconds."""
        events = sorted(set(map(str, event_ids)))
        if not events or len(events) != len(event_ids):
            raise ValueError("event_ids must be a set of at least one")
        token = uuid.uuid4().hex
        held = {"token": token, "spec_hash": spec_hash, "dataset_hash": dataset_hash, "event_ids": events}
        made = []
        try:
            for name, what in [(f"claims/{_name(e)}.json", f"event {e}") for e in events] + [(f"reservations/{_name(spec_hash)}.json", f"specification {spec_hash}")]:
                if not self._claim(name, token, lease):
                    raise RegistryConflict(f"{what} is claimed")
                made.append(name)
            if not all((self._read(name) or {}).get("token") == token for name in made):
                raise RegistryConflict("a claim was taken over; the lease is too short")
            self._create(f"tokens/{token}.json", held)
        except BaseException:
            for name in made:
                if (self._read(name) or {}).get("token") == token:
                    self._delete(name)
            raise
        return token

    def _claim(self, name: str, token: str, lease: float) -> bool:
        mine = {"token": token, "at": time.time()}
        if self._create(name, mine):
            return True
        held = self._read(name)
        if held is None or self._read(f"tokens/{held['token']}.json") is not None or time.time() - held["at"] < lease:
            return False
        self._delete(name)
        return self._create(name, mine)

    def finish(self, token: str, status: str, result: dict) -> None:
        """Ends a locked test once; the same outcome again is no change."""
        if status not in ENDINGS:
            raise ValueError(f"status must be one of {ENDINGS}")
        if self._read(f"tokens/{token}.json") is None:
            raise ValueError(f"no reservation for {token}")
        outcome = {"token": token, "status": status, "result": result}
        if not self._create(f"outcomes/{token}.json", outcome) and self._read(f"outcomes/{token}.json") != json.loads(canonical(outcome)):
            raise RegistryConflict(f"{token} ended otherwise")

    def runs(self) -> DataFrame:
        """All runs, in the order of (created_at, run_id): (run_id, created_at, payload)."""
        texts = self.spark.read.text(f"{self.root}/runs", wholetext=True)
        return texts.select(F.get_json_object("value", "$.run_id").alias("run_id"), F.get_json_object("value", "$.created_at").alias("created_at"), F.col("value").alias("payload")).orderBy("created_at", "run_id")


def export_lines(registry: RunRegistry) -> list[str]:
    """All runs as canonical JSON, a line each, by (created_at, run_id). Control plane: a handful of runs."""
    return [canonical(json.loads(r["payload"])) for r in registry.runs().collect()]


def lossless(value: object, notes: list[str], at: str = "$") -> object:
    """value as strict JSON: decimals and instants as text, numbers that are not finite as null, each with a note of where."""
    if isinstance(value, dict):
        return {str(k): lossless(v, notes, f"{at}.{k}") for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [lossless(v, notes, f"{at}[{i}]") for i, v in enumerate(value)]
    if isinstance(value, float) and not math.isfinite(value):
        notes.append(f"{at}: {value} is written as null")
        return None
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"{at}: {type(value).__name__} has no JSON form")


def write_report(spark: SparkSession, report: dict, path: str) -> list[str]:
    """Writes a report once, as strict JSON, and returns the notes on what it could not carry; other content at that place raises."""
    notes: list[str] = []
    text = canonical(lossless(report, notes)).encode()
    if not create_once(spark, path, text) and spark.read.text(path, wholetext=True).first()[0].encode() != text:
        raise RegistryConflict(f"{path} holds another report")
    return notes


def file_digests(spark: SparkSession, root: str, names: list[str]) -> dict[str, str | None]:
    """sha256 of each named file under root; an absent one is null, not left out. Executors read the bytes."""
    held, where = dict.fromkeys(sorted(names)), {}
    for name in held:
        fs, at = _file(spark, f"{root}/{name}")
        if fs.exists(at):
            where[fs.makeQualified(at).toString()] = name
    if where:
        for r in spark.read.format("binaryFile").load(list(where)).select("path", F.sha2("content", 256).alias("digest")).collect():  # one row a declared file
            held[where[r["path"]]] = r["digest"]
    return held


def freeze(spark: SparkSession, root: str, names: list[str], frozen_at: str, stopping_rule: dict) -> dict:
    """What was declared at one instant: the files' digests, the rule, and a digest for each of its own fields."""
    files = file_digests(spark, root, names)
    manifest = {"frozen_at": frozen_at, "stopping_rule": stopping_rule, "files": files, "absent": [n for n, d in files.items() if d is None]}
    return manifest | {"freeze_hash": _name(canonical(files)), "fields": {k: _name(canonical(v)) for k, v in manifest.items()}}


def verify_freeze(spark: SparkSession, root: str, manifest: dict, names: list[str] | None = None) -> dict:
    """Reports all that moved since: drifted, missing and undeclared files and fields that are not the sealed ones."""
    declared = manifest["files"]
    now = file_digests(spark, root, list(declared))
    fields = [k for k, d in manifest.get("fields", {}).items() if _name(canonical(manifest.get(k))) != d] if "fields" in manifest else ["fields"]
    out = {
        "drifted": [n for n, d in declared.items() if now[n] is not None and now[n] != d], "missing": [n for n in declared if now[n] is None], "undeclared": sorted(set(names or []) - set(declared)), "fields_moved": fields,
        "hash_matches": _name(canonical(declared)) == manifest.get("freeze_hash"),
    }
    return out | {"verified": out["hash_matches"] and not any(out[k] for k in ("drifted", "missing", "undeclared", "fields_moved"))}
