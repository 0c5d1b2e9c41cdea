"""Versioned mapping contracts compiled to DataFrame projections.

A contract is a small JSON-like document of ordered field rules. It is
resolved and fingerprinted once on the driver and compiled into a list of
Column expressions, so every record is mapped by one ``select`` inside
whole-stage codegen (no per-row Python, no per-row contract reload).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from ..config import CONTRACTS, REGISTRY
from ..functions import text as T
from ..functions.hashing import canonical_json_sha256


class MappingError(ValueError):
    """Raised for unknown mappings, versions, transforms or mismatched identity."""


@dataclass(frozen=True)
class SourcePath:
    """A parsed field source: the landed record, a computed or constant value, or
    the steps into a record's struct."""
    kind: str
    steps: tuple[str, ...]

    @classmethod
    def parse(cls, text: str) -> SourcePath:
        head, *rest = text.split(".")
        if head == "$record" and not rest:
            return cls("record", ())
        if head in ("$computed", "$constant") and rest:
            return cls(head[1:], (".".join(rest),))
        return cls("field", (head, *rest))

    def column(self, df: DataFrame, computed: dict, constants: dict, record_col: str) -> tuple[Column, DataType]:
        """The source's column and type; what a record doesn't have is a null string."""
        none = (F.lit(None).cast("string"), StringType())
        if self.kind == "record":
            return F.col(record_col), StringType()
        if self.kind == "computed":
            return (computed[self.steps[0]], StringType()) if self.steps[0] in computed else none
        if self.kind == "constant":
            return F.lit(constants.get(self.steps[0])).cast("string"), StringType()
        at: DataType = df.schema
        for step in self.steps:
            inner = {f.name: f.dataType for f in getattr(at, "fields", ())}
            if step not in inner:
                return none
            at = inner[step]
        return F.col(".".join(f"`{s}`" for s in self.steps)), at


@dataclass(frozen=True)
class Rule:
    """One target column of a contract."""
    target: str
    source: SourcePath
    source_text: str
    transform: str
    type: str
    required: bool


@dataclass(frozen=True)
class Contract:
    """A validated, immutable version of a mapping."""
    mapping_id: str
    version: str
    entity: str
    rules: tuple[Rule, ...]
    sha256: str


class ContractRegistry:
    """All versions of all mappings, checked once when the registry is built:
    what is unknown or inconsistent fails here, before any job."""

    def __init__(self, registry: dict, documents: dict):
        self.active: dict[str, str] = {}
        self.versions: dict[str, tuple[str, ...]] = {}
        self._by_key: dict[tuple[str, str], Contract] = {}
        self._broken: set[tuple[str, str]] = set()
        for name, entry in registry.get("mappings", {}).items():
            self.active[name] = entry["active"]
            self.versions[name] = tuple(sorted(entry.get("versions", ())))
            for number in self.versions[name]:
                body = documents.get((name, number)) or {}
                if (body.get("mapping_id"), body.get("version")) != (name, number):
                    self._broken.add((name, number))
                    continue
                self._by_key[name, number] = self._contract(body)

    @staticmethod
    def _contract(body: dict) -> Contract:
        rules = tuple(Rule(f["target"], SourcePath.parse(f["source"]), f["source"], f.get("transform", "identity"),
                           f.get("type", "string"), bool(f.get("required"))) for f in body["fields"])
        return Contract(body["mapping_id"], body["version"], body["target"]["entity"], rules, canonical_json_sha256(body))

    def get(self, mapping_id: str, version: str | None = None) -> Contract:
        if mapping_id not in self.active:
            raise MappingError(f"no mapping is named {mapping_id!r}")
        key = (mapping_id, version or self.active[mapping_id])
        if key in self._broken:
            raise MappingError(f"the document of {'@'.join(key)} names another mapping or version")
        if key not in self._by_key:
            raise MappingError(f"mapping {mapping_id!r} has no version {key[1]!r}")
        return self._by_key[key]

    def __iter__(self):
        return iter(sorted(self.active))


def default_registry() -> ContractRegistry:
    return ContractRegistry(REGISTRY, CONTRACTS)


def contract(mapping_id: str, version: str | None = None) -> Contract:
    return default_registry().get(mapping_id, version)


def mapping_catalog(spark: SparkSession, registry: ContractRegistry | None = None) -> DataFrame:
    known = registry or default_registry()
    rows = [(name, known.active[name], list(known.versions[name]), c.entity, len(c.rules), c.sha256)
            for name in known for c in (known.get(name),)]
    return spark.createDataFrame(rows, "mapping_id string, active_version string, available_versions array<string>, "
                                       "target string, field_count int, sha256 string")


def field_lineage(spark: SparkSession, mapping_id: str, version: str | None = None) -> DataFrame:
    c = contract(mapping_id, version)
    rows = [(c.mapping_id, c.version, i, r.source_text, r.target, r.transform) for i, r in enumerate(c.rules)]
    return spark.createDataFrame(rows, "mapping_id string, mapping_version string, position int, source string, "
                                       "target string, transform string")


# --- transform table: name -> (value builder, error predicate) -------------------------------

@dataclass(frozen=True)
class Transform:
    """``prepare`` makes the text that ``finish`` and ``finish_error`` read several times: ``build`` is ``finish`` over it."""
    build: Callable[[Column, DataType], Column]
    error: Callable[[Column, DataType], Column] | None = None
    error_class: str = "ValueError"
    prepare: Callable[[Column], Column] | None = None
    finish: Callable[[Column], Column] | None = None
    finish_error: Callable[[Column], Column] | None = None


TRANSFORMS: dict[str, Transform] = {
    "identity": Transform(lambda c, t: c),
    "to_string": Transform(lambda c, t: c.cast("string")),
    "trim": Transform(lambda c, t: T.py_strip(c)),
    "uppercase": Transform(lambda c, t: T.py_upper(c)),
    "normalize_project_id": Transform(lambda c, t: T.normalize_project_id(c), prepare=T.squeezed, finish=T.project_id_of),
    "normalize_date": Transform(lambda c, t: T.normalize_date(c), prepare=T.py_strip, finish=T.date_of),
    "join_list": Transform(lambda c, t: T.join_list(c, t)),
    "to_number": Transform(lambda c, t: T.to_number(c), lambda c, t: T.to_number_error(c),
                           prepare=T.ascii_digits, finish=T.number_of, finish_error=T.number_error_of),
    # The landed text is kept while records are classified and fingerprinted; sinks write it in canonical form
    # (functions/jsontext.py), so that no row goes through Python before it is known to be loaded.
    "serialize_json": Transform(lambda c, t: c),
}

_OWN = dict(TRANSFORMS)

_TARGET_TYPES = {"string": "string", "date": "date", "number": "double", "json": "string"}


def register_transform(name: str, build: Callable[[Column, DataType], Column],
                       error: Callable[[Column, DataType], Column] | None = None) -> None:
    TRANSFORMS[name] = Transform(build, error)


@dataclass
class CompiledContract:
    mapping_id: str
    version: str
    sha256: str
    columns: list[Column]
    error: Column
    error_field: Column
    targets: list[str]
    # The same checks over a frame that has the target columns: (the transform's own check or None for an empty target, error class, target)
    checks: list[tuple[Column | None, str, str]]
    texts: set[str]


def compile_contract(df: DataFrame, mapping_id: str, version: str | None = None,
                     computed: dict | None = None, constants: dict | None = None,
                     record_col: str = "raw_json", known: dict[tuple[str, str], str] | None = None,
                     prepared: dict[str, Column] | None = None) -> CompiledContract:
    """``known`` names the columns of ``df`` that hold a (source, transform)'s values already. With ``prepared``, a dict that is filled, the
    texts that transforms read several times are columns of their own, which the caller adds to ``df`` first."""
    doc = contract(mapping_id, version)
    computed, constants = computed or {}, constants or {}
    cols, errors, targets, checks, texts = [], [], [], [], set()
    for rule in doc.rules:
        if rule.transform not in TRANSFORMS:
            raise MappingError(f"no transform is named {rule.transform!r}")
        tr = TRANSFORMS[rule.transform]
        source, dtype = rule.source.column(df, computed, constants, record_col)
        cast_to = _TARGET_TYPES.get(rule.type, "string")
        have = (known or {}).get((rule.source_text, rule.transform)) if tr.error is None and tr is _OWN.get(rule.transform) else None
        text = None
        if have is not None:
            value = F.col(have).cast(cast_to)
        elif prepared is not None and tr.prepare is not None:
            text = f"_prepared_{len(prepared)}"
            prepared[text] = tr.prepare(source)
            value = tr.finish(F.col(text)).cast(cast_to)
        else:
            value = tr.build(source, dtype).cast(cast_to)
        if tr.error is not None:
            errors.append((tr.finish_error(F.col(text)) if text else tr.error(source, dtype), tr.error_class, rule.target))
            checks.append(errors[-1])
        if rule.required:
            empty = value.isNull()
            if cast_to == "string":
                empty = empty | (value == "")
                texts.add(rule.target)
            errors.append((empty, "MappingError", rule.target))
            checks.append((None, "MappingError", rule.target))
        cols.append(value.alias(rule.target))
        targets.append(rule.target)
    none = F.lit(None).cast("string")
    error = F.coalesce(*[F.when(c, F.lit(k)) for c, k, _ in errors]) if errors else none
    error_field = F.coalesce(*[F.when(c, F.lit(t)) for c, _, t in errors]) if errors else none
    return CompiledContract(mapping_id, doc.version, doc.sha256, cols, error, error_field, targets, checks, texts)


def apply_contract(df: DataFrame, mapping_id: str, version: str | None = None,
                   computed: dict | None = None, constants: dict | None = None,
                   keep: list[str] | None = None, record_col: str = "raw_json", known: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Mapped target columns + ``mapping_error`` (first failing field's error class, in contract order) + any ``keep`` columns.

    The prepared texts are one projection, the values another over it and the checks a third: what several patterns or checks read is
    not computed again for each of them."""
    prepared: dict[str, Column] = {}
    cc = compile_contract(df, mapping_id, version, computed, constants, record_col, known, prepared)
    df = df.select("*", *[c.alias(name) for name, c in prepared.items()])
    keep = keep or []
    own = [(c.alias(f"_check_{i}"), i) for i, (c, _, _) in enumerate(cc.checks) if c is not None]
    values = df.select(*[F.col(k) for k in keep], *cc.columns, *[c for c, _ in own])
    failed = [F.col(f"_check_{i}") if c is not None else
              F.col(t).isNull() | (F.col(t) == "") if t in cc.texts else F.col(t).isNull() for i, (c, _, t) in enumerate(cc.checks)]
    none = F.lit(None).cast("string")
    error, error_field = (F.coalesce(none, *[F.when(f, F.lit(c[at])) for f, c in zip(failed, cc.checks, strict=True)]) for at in (1, 2))
    return values.select(*keep, *cc.targets, error.alias("mapping_error"), error_field.alias("mapping_error_field"))
