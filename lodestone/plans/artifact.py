"""Compiled queries in a versioned container.

Bytes: the magic, a format byte, and JSON with the version, the plan, the contracts and a hash
of the rest. Metadata can be read without the plan.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.contracts import Contract, ContractError, Field, validate
from lodestone.plans.expr import Expr
from lodestone.plans.plan import Plan, frame

MAGIC = b"LODE"
FORMAT_JSON = 1
VERSION = (1, 0, 0)


def compatible(have: tuple[int, int, int], other: tuple[int, int, int]) -> bool:
    """Whether an engine of version ``have`` reads what version ``other`` wrote."""
    return have[0] == other[0] and have[1] >= other[1]


def encode_value(value: Any) -> Any:
    if isinstance(value, Plan):
        return {"$plan": value.op, "children": [encode_value(c) for c in value.children], "props": encode_value(list(value.props))}
    if isinstance(value, Expr):
        return {"$expr": value.op, "args": [encode_value(a) for a in value.args], "props": encode_value(list(value.props))}
    if isinstance(value, (list, tuple)):
        return [encode_value(v) for v in value]
    if isinstance(value, bytes):
        return {"$bytes": value.hex()}
    if isinstance(value, decimal.Decimal):
        return {"$decimal": str(value)}
    if isinstance(value, datetime.datetime):
        return {"$timestamp": value.isoformat()}
    if isinstance(value, datetime.date):
        return {"$date": value.isoformat()}
    if isinstance(value, datetime.time):
        return {"$time": value.isoformat()}
    if hasattr(value, "to_json"):
        return {"$graph": value.to_json()}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"{type(value).__name__} cannot be stored")


def decode_value(value: Any) -> Any:
    if isinstance(value, list):
        return tuple(decode_value(v) for v in value)
    if not isinstance(value, dict):
        return value
    if "$plan" in value:
        return Plan(value["$plan"], tuple(decode_value(c) for c in value["children"]), decode_value(value["props"]))
    if "$expr" in value:
        return Expr(value["$expr"], tuple(decode_value(a) for a in value["args"]), decode_value(value["props"]))
    (tag, body), *_ = value.items()
    if tag == "$graph":
        from lodestone.ml.graph import Graph

        return Graph.from_json(body)
    return {
        "$bytes": bytes.fromhex,
        "$decimal": decimal.Decimal,
        "$timestamp": datetime.datetime.fromisoformat,
        "$date": datetime.date.fromisoformat,
        "$time": datetime.time.fromisoformat,
    }[tag](body)


def plan_hash(plan: Plan) -> str:
    return hashlib.sha256(json.dumps(encode_value(plan), sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Artifact:
    plan: Plan
    contracts: tuple[Contract, ...] = ()
    version: tuple[int, int, int] = VERSION

    def to_bytes(self) -> bytes:
        body = {
            "version": list(self.version),
            "hash": plan_hash(self.plan),
            "contracts": [
                {"relation": c.relation, "fields": [[f.name, f.type, f.nullable, f.metadata] for f in c.fields], "fingerprint": c.fingerprint}
                for c in self.contracts
            ],
            "plan": encode_value(self.plan),
        }
        return MAGIC + bytes([FORMAT_JSON]) + json.dumps(body, sort_keys=True).encode()

    @staticmethod
    def inspect(data: bytes) -> dict:
        """Version, hash and contracts, without decoding the plan."""
        body = _body(data)
        return {k: v for k, v in body.items() if k != "plan"}

    @staticmethod
    def from_bytes(data: bytes) -> Artifact:
        body = _body(data)
        version = tuple(body["version"])
        if not compatible(VERSION, version):
            raise ValueError(f"version {version} cannot be read by {VERSION}")
        plan = decode_value(body["plan"])
        if plan_hash(plan) != body["hash"]:
            raise ValueError("the plan does not have the hash that it was stored with")
        contracts = tuple(Contract(c["relation"], tuple(Field(*f) for f in c["fields"]), c["fingerprint"]) for c in body["contracts"])
        return Artifact(plan, contracts, version)

    def run(self, spark: SparkSession, strict: bool = False, check: bool = True) -> DataFrame:
        """The plan's DataFrame, once the session's tables hold to the contracts."""
        if check:
            problems = validate(spark, list(self.contracts), strict)
            if problems:
                raise ContractError(problems)
        return frame(spark, self.plan)


def _body(data: bytes) -> dict:
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a compiled query")
    if data[len(MAGIC)] != FORMAT_JSON:
        raise ValueError(f"unknown format {data[len(MAGIC)]}")
    return json.loads(data[len(MAGIC) + 1 :])
