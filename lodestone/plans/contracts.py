"""Schema fingerprints and contracts, checked before a stored query runs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from lodestone.plans.types import spark_type, type_name, widens


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True
    metadata: str = ""

    @property
    def canonical(self) -> str:
        return f"{self.name}:{self.type}:{str(self.nullable).lower()}" + (f",metadata<{self.metadata}>" if self.metadata else "")


def fields_of(schema: T.StructType) -> tuple[Field, ...]:
    return tuple(
        Field(f.name, type_name(f.dataType), f.nullable, json.dumps(f.metadata, sort_keys=True) if f.metadata else "") for f in schema.fields
    )


def fingerprint(fields: tuple[Field, ...]) -> int:
    """64 bits that do not depend on the order of the fields."""
    text = "\n".join(sorted(f.canonical for f in fields))
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


@dataclass(frozen=True)
class Contract:
    """What a query needs of a relation."""

    relation: str
    fields: tuple[Field, ...]
    fingerprint: int = field(default=0)

    @staticmethod
    def of(relation: str, schema: T.StructType) -> Contract:
        own = fields_of(schema)
        return Contract(relation, own, fingerprint(own))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable) for f in self.fields])


@dataclass(frozen=True)
class Violation:
    relation: str
    problem: str  # "table missing", "field missing" or "type"
    detail: str = ""


class ContractError(ValueError):
    def __init__(self, violations: list[Violation]):
        self.violations = violations
        super().__init__("; ".join(f"{v.relation}: {v.problem} {v.detail}".strip() for v in violations))


def validate(spark: SparkSession, contracts: list[Contract], strict: bool = False) -> list[Violation]:
    """What the session's tables lack. ``strict`` asks for equal types, else widening will do."""
    out = []
    for contract in contracts:
        if not spark.catalog.tableExists(contract.relation):
            out.append(Violation(contract.relation, "table missing"))
            continue
        have = {f.name.lower(): f for f in fields_of(spark.table(contract.relation).schema)}
        for want in contract.fields:
            got = have.get(want.name.lower())
            if got is None:
                out.append(Violation(contract.relation, "field missing", want.name))
            elif got.type != want.type if strict else not widens(got.type, want.type):
                out.append(Violation(contract.relation, "type", f"{want.name}: {got.type} for {want.type}"))
    return out
