"""Chat records of any layout to canonical turns, chosen by schema fingerprint.

A record is a JSON text. Its *schema* is the set of nested field paths with the kinds found there (``messages[].role:STRING``), its *fingerprint* the hash of that set. Both are
computed in the JVM from the record's variant, so records of one layout share a fingerprint however their values differ. The distinct fingerprints, a
small table, are resolved once: the first *mapping* whose required paths a schema holds. A mapping is declarative: where the list of turns is and how its fields and roles are named, or which fields
make which turns. Records are then converted by expressions only, one branch for each mapping, selected by fingerprint.

Defined cases. Null, empty and malformed records, records of an id that is null in the flat table, and schemas that no mapping fits, give no turn in :func:`turns`; :func:`resolved` shows their fingerprints with a null mapping. Absent and null fields make no
turn; an empty text is a turn. Unknown roles are kept in lower case; a null role is ``user``. Turns keep the record's order and are numbered from 0. Records that repeat are converted each; extra fields
beside the required paths don't hinder a mapping. Records of any length are converted whole, and an empty table gives no turns. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import mapped

ROLES = {"human": "user", "prompter": "user", "instruction": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatgpt": "assistant", "response": "assistant", "developer": "system"}


@dataclass(frozen=True)
class Mapping:
    """``needs``: paths that a schema must hold. Either ``turns`` = (path of the list, role field, text field), after an optional ``system`` field, or ``fields`` = ((role, path or paths joined by a blank line), ...).
    ``pairs`` = path of a list of two-string lists of earlier user and assistant turns, which follow the system field. ``single`` = (role field, text field) of a record that is one turn.
    An empty path is the record itself. A text that is a list of parts, strings or objects with a ``text``, is its parts' texts joined."""

    name: str
    needs: frozenset[str]
    turns: tuple[str, str, str] | None = None
    system: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    pairs: str | None = None
    single: tuple[str, str] | None = None


#: In order of preference.
MAPPINGS = (
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), turns=("messages", "role", "content"), system="system"),
    Mapping("conversations", frozenset({"conversations[].from", "conversations[].value"}), turns=("conversations", "from", "value"), system="system"),
    Mapping("dialog", frozenset({"dialog.turns[].speaker", "dialog.turns[].utterance"}), turns=("dialog.turns", "speaker", "utterance"), system="dialog.system"),
    Mapping("history", frozenset({"history[][]", "instruction", "output"}), system="system", pairs="history", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", frozenset({"instruction", "output"}), system="system", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt_completion", frozenset({"prompt", "completion"}), system="system", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", frozenset({"prompt", "response"}), system="system", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", frozenset({"data.question", "data.answer"}), system="data.context", fields=(("user", ("data.question",)), ("assistant", ("data.answer",)))),
    Mapping("role_text", frozenset({"role", "text"}), single=("role", "text")),
    Mapping("instruction_only", frozenset({"instruction"}), system="system", fields=(("user", ("instruction", "input")),)),
    Mapping("prompt_only", frozenset({"prompt"}), system="system", fields=(("user", ("prompt",)),)),
    Mapping("message_list", frozenset({"[].role", "[].content"}), turns=("", "role", "content")),
    Mapping("conversation_list", frozenset({"[].from", "[].value"}), turns=("", "from", "value")),
)
#: Distinct schemas up to this many are resolved through the driver and broadcast; beyond, by a join.
RESOLVE = 100_000


def paths(schema: str | None) -> frozenset[str]:
    """The leaf and inner paths of a variant's schema text, as ``OBJECT<a: ARRAY<OBJECT<b: STRING>>>``; kinds are dropped but for the nesting."""
    out: set[str] = set()
    if not schema:
        return frozenset()

    def walk(at: int, prefix: str) -> int:
        if schema.startswith("OBJECT<", at):
            at += 7
            while schema[at] != ">":
                if schema[at] == "`":
                    end = at + 1
                    while schema[end] != "`" or schema[end + 1] == "`":
                        end += 2 if schema[end] == "`" else 1
                    name, at = schema[at + 1 : end].replace("``", "`"), end + 1
                else:
                    end = schema.index(":", at)
                    name, at = schema[at:end], end
                path = f"{prefix}.{name}" if prefix else name
                out.add(path)
                at = walk(at + 2, path)
                if schema.startswith(", ", at):
                    at += 2
            return at + 1
        if schema.startswith("ARRAY<", at):
            out.add(prefix + "[]")
            return walk(at + 6, prefix + "[]") + 1
        while at < len(schema) and schema[at] not in ",>":
            at = schema.index(")", at) + 1 if schema[at] == "(" else at + 1
        return at

    walk(0, "")
    return frozenset(out)


def mapping_of(schema: str | None, mappings: tuple[Mapping, ...] = MAPPINGS) -> str | None:
    have = paths(schema)
    return next((m.name for m in mappings if m.needs <= have), None)


def fingerprinted(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with ``__v`` (the variant), ``__schema`` and ``__fingerprint``; numbers' kinds are one, so that values don't tell layouts apart."""
    schema = F.regexp_replace(F.schema_of_variant(F.col("__v")), r"\b(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))", "NUMBER")
    return records.withColumn("__v", F.try_parse_json(F.col(record))).withColumn("__schema", schema).withColumn("__fingerprint", F.xxhash64("__schema"))


def resolved(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``fingerprint, schema, mapping, records`` for each layout that occurs."""
    found = fingerprinted(records.select(record), record).groupBy("__fingerprint", "__schema").agg(F.count("*").alias("records"))


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = pa.array([mapping_of(s, mappings) for s in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), names, b.column(2)], names=["fingerprint", "schema", "mapping", "records"])

    # unlike a function in an expression, this stays above the aggregate: it sees each layout once, not each record
    return mapped(found, run, "fingerprint bigint, schema string, mapping string, records bigint")


def _path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split(".") if p)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, _path(path), "string")


def _whole(v: Column) -> Column:
    """A text, or the joined texts of a list of parts."""
    each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$.text", "string")).otherwise(F.try_variant_get(x, "$", "string")))
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(each, "")).otherwise(F.try_variant_get(v, "$", "string"))


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))


def _role(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit("user"))))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[low], low)


def _converted(v: Column, m: Mapping) -> Column:
    """The turns of one mapping as an array of role and text."""
    parts = []
    if m.system:
        parts.append(F.array(_turn("system", _text(v, m.system))))
    if m.turns:
        where, role, text = m.turns
        items = F.try_variant_get(v, _path(where), f"array<struct<`{role}`:string,`{text}`:variant>>")
        parts.append(F.transform(items, lambda x: _turn(_role(x[role]), _whole(x[text]))))
    if m.pairs:
        items = F.try_variant_get(v, f"$['{m.pairs}']", "array<array<string>>")
        parts.append(F.flatten(F.transform(items, lambda x: F.array(_turn("user", F.get(x, F.lit(0))), _turn("assistant", F.get(x, F.lit(1)))))))
    if m.single:
        role, text = m.single
        parts.append(F.array(_turn(_role(_text(v, role)), _whole(F.try_variant_get(v, _path(text), "variant")))))
    for role, fields in m.fields:
        some = [_text(v, f) for f in fields]
        first = some[0]
        if len(some) > 1:
            more = F.concat_ws("\n\n", *[F.when(F.length(s) > 0, s) for s in some])
            first = F.when(F.coalesce(*some).isNotNull(), more)
        parts.append(F.array(_turn(role, first)))
    empty = F.from_json(F.lit("[]"), "array<struct<role:string,text:string>>")
    return F.filter(F.concat(*[F.coalesce(p, empty) for p in parts]), lambda x: x["text"].isNotNull())


def turns(records: DataFrame, key: str = "conv_id", record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``key, turn, role, text``: the canonical turns of each record. Two narrow passes; between them only distinct layouts are gathered."""
    table = resolved(records, record, mappings).where("mapping is not null").select("fingerprint", "mapping").distinct()
    seen = fingerprinted(records.select(key, record), record)
    found = table.limit(RESOLVE + 1).collect()
    if len(found) <= RESOLVE:
        by: dict[str, list[int]] = {}
        for r in found:
            by.setdefault(r["mapping"], []).append(r["fingerprint"])
        chosen = F.lit(None).cast("string")
        for name, prints in sorted(by.items()):
            chosen = F.when(F.col("__fingerprint").isin(prints), F.lit(name)).otherwise(chosen)
        seen = seen.withColumn("__mapping", chosen)
    else:
        seen = seen.join(table.withColumnsRenamed({"fingerprint": "__fingerprint", "mapping": "__mapping"}), "__fingerprint")
    out = F.lit(None)
    for m in reversed(mappings):
        out = F.when(F.col("__mapping") == m.name, _converted(F.col("__v"), m)).otherwise(out)
    return seen.where("__mapping is not null").select(key, F.posexplode(out).alias("turn", "t")).select(key, F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def as_records(conversations: DataFrame) -> DataFrame:
    """``conv_id, record``: each conversation as one JSON record, in one of the layouts that its turns allow, chosen by its id.

    The table is flat; this makes of it the mixed input that the operator is for. Turns are put in order of their number.
    """
    talk = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    is_system = F.get("t", F.lit(0))["role"] == "system"
    rest = F.when(is_system, F.slice("t", 2, F.size("t"))).otherwise(F.col("t"))
    alternate = F.forall(F.sequence(F.lit(0), F.greatest(F.size("rest") - 1, F.lit(0))), lambda i: F.get(F.col("rest"), i)["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    whole = F.forall("t", lambda x: x["text"].isNotNull() & (F.length(x["text"]) > 0) & x["role"].isNotNull())
    t = talk.withColumn("rest", rest).withColumn("system", F.when(is_system, F.get("t", F.lit(0))["text"]))
    t = t.withColumn("paired", whole & alternate & (F.size("rest") >= 2) & (F.size("rest") % 2 == 0) & ~F.exists("rest", lambda x: x["role"] == "system"))
    t = t.withColumn("kind", F.pmod(F.col("conv_id"), F.lit(6)))
    text = lambda i: F.get(F.col("rest"), F.lit(i))["text"]
    last = F.size("rest") - 2
    two = F.col("paired") & (F.size("rest") == 2)
    pairs = F.transform(F.sequence(F.lit(0), (last / 2).cast("int") - 1), lambda i: F.array(F.get(F.col("rest"), (i * 2).cast("int"))["text"], F.get(F.col("rest"), (i * 2 + 1).cast("int"))["text"]))
    name = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    record = (
        F.when(two & (F.col("kind") == 1), F.to_json(F.struct("system", text(0).alias("instruction"), F.lit("").alias("input"), text(1).alias("output"))))
        .when(two & (F.col("kind") == 2), F.to_json(F.struct("system", text(0).alias("prompt"), text(1).alias("completion"))))
        .when(two & (F.col("kind") == 4), F.to_json(F.struct(F.struct(F.col("system").alias("context"), text(0).alias("question"), text(1).alias("answer")).alias("data"))))
        .when(F.col("paired") & (F.size("rest") > 2) & F.col("kind").isin(1, 2), F.to_json(F.struct("system", pairs.alias("history"), F.get("rest", last)["text"].alias("instruction"), F.get("rest", last + 1)["text"].alias("output"))))
        .when(F.col("kind") == 3, F.to_json(F.struct(F.transform("t", lambda x: F.struct(name(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .when(F.col("kind") == 5, F.to_json(F.struct(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("speaker"), x["text"].alias("utterance"))).alias("turns")).alias("dialog"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    )
    return t.select("conv_id", record.alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, put in mixed layouts and brought back."""
    return turns(as_records(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = """
select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as turn, lower(trim(coalesce(role, 'user'))) as role, text
from conversations where conv_id is not null and text is not null"""
