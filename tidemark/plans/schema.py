"""Jobs over column catalogues: thousands of tables' columns, indexes and keys as DataFrames.

A column catalogue has table, column, position, native_type and, where known, length, precision, scale, nullable, default_value,
default_kind, auto_increment, generated.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import coerced

#: Families of dialects that share their type names.
FAMILY = {"postgresql": "pg", "kingbasees": "pg", "opengauss": "pg", "mysql": "my", "mariadb": "my", "sqlite": "lite", "sqlserver": "ms", "clickhouse": "ch", "duckdb": "duck", "dm8": "dm"}
#: Native type names by family and canonical type (fixed values).
NAMES: dict[str, dict[str, tuple[str, ...]]] = {
    "pg": {
        "Boolean": ("boolean", "bool"),
        "Int16": ("smallint", "int2"),
        "Int32": ("integer", "int4", "int"),
        "Int64": ("bigint", "int8"),
        "Decimal": ("numeric", "decimal", "money"),
        "Single": ("real", "float4"),
        "Double": ("double precision", "float8"),
        "VarChar": ("character varying", "varchar"),
        "Char": ("character", "bpchar", "char"),
        "Text": ("text", "citext"),
        "Date": ("date",),
        "Time": ("time", "time without time zone", "time with time zone"),
        "DateTime": ("timestamp", "timestamp without time zone"),
        "DateTimeOffset": ("timestamp with time zone",),
        "Binary": ("bytea",),
        "Guid": ("uuid",),
        "Json": ("json", "jsonb"),
        "Xml": ("xml",),
    },
    "my": {
        "Int16": ("tinyint", "smallint", "year"),
        "Int32": ("mediumint", "int", "integer"),
        "Int64": ("bigint",),
        "Decimal": ("decimal", "numeric"),
        "Single": ("float",),
        "Double": ("double", "real"),
        "Char": ("char",),
        "VarChar": ("varchar", "enum", "set"),
        "Text": ("tinytext", "text", "mediumtext", "longtext"),
        "Date": ("date",),
        "DateTime": ("datetime", "timestamp"),
        "Time": ("time",),
        "Binary": ("bit", "binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob"),
        "Json": ("json",),
        "Guid": ("uuid",),
    },
    "ms": {
        "Boolean": ("bit",),
        "Int16": ("tinyint", "smallint"),
        "Int32": ("int",),
        "Int64": ("bigint",),
        "Decimal": ("decimal", "numeric", "money", "smallmoney"),
        "Double": ("float",),
        "Single": ("real",),
        "Char": ("char", "nchar"),
        "VarChar": ("varchar", "nvarchar"),
        "Text": ("text", "ntext"),
        "Date": ("date",),
        "Time": ("time",),
        "DateTime": ("datetime", "datetime2", "smalldatetime"),
        "DateTimeOffset": ("datetimeoffset",),
        "Binary": ("binary", "varbinary", "image"),
        "Guid": ("uniqueidentifier",),
        "Xml": ("xml",),
    },
    "ch": {
        "Int16": ("int8", "int16", "uint8"),
        "Int32": ("int32", "uint16"),
        "Int64": ("int64", "uint32"),
        "Decimal": ("uint64", "decimal"),
        "Single": ("float32",),
        "Double": ("float64",),
        "Text": ("string",),
        "Char": ("fixedstring",),
        "Guid": ("uuid",),
        "Date": ("date", "date32"),
        "DateTime": ("datetime", "datetime64"),
        "VarChar": ("ipv4", "ipv6", "enum8", "enum16"),
        "Json": ("json", "array", "map", "tuple", "nested"),
    },
    "duck": {
        "Boolean": ("boolean", "bool"),
        "Int16": ("tinyint", "smallint", "utinyint"),
        "Int32": ("integer", "int", "int32", "usmallint"),
        "Int64": ("bigint", "int64", "uinteger", "uint", "uint32"),
        "Decimal": ("hugeint", "ubigint", "decimal", "numeric"),
        "Single": ("float", "float4", "real"),
        "Double": ("double", "float8"),
        "Char": ("char", "bpchar"),
        "VarChar": ("varchar",),
        "Text": ("text", "string"),
        "Binary": ("blob", "bytea"),
        "Date": ("date",),
        "Time": ("time",),
        "DateTime": ("timestamp", "datetime"),
        "DateTimeOffset": ("timestamptz", "timestamp with time zone"),
        "Guid": ("uuid",),
        "Json": ("json", "list", "struct", "map", "union", "enum", "array"),
    },
    "dm": {
        "Boolean": ("bit",),
        "Int16": ("tinyint", "smallint"),
        "Int32": ("int", "integer", "pls_integer", "binary_integer"),
        "Int64": ("bigint",),
        "Decimal": ("number", "numeric", "decimal", "dec"),
        "Single": ("binary_float",),
        "Double": ("binary_double", "float", "double precision"),
        "Char": ("char", "nchar", "character"),
        "VarChar": ("varchar", "varchar2", "nvarchar", "nvarchar2"),
        "Text": ("clob", "nclob", "text", "long", "longvarchar"),
        "Binary": ("blob", "raw", "long raw", "varbinary", "binary", "image"),
        "Time": ("time",),
        "DateTime": ("date", "timestamp", "datetime"),
        "DateTimeOffset": ("timestamp with time zone", "timestamp with local time zone", "timestamptz"),
        "Xml": ("xmltype",),
    },
}
#: Type names with a length or a precision and scale of their own (fixed values).
OWN_LENGTH = {"my": {"enum": 255, "set": 255}, "ch": {"ipv4": 45, "ipv6": 45, "enum8": 255, "enum16": 255}}
OWN_DECIMAL = {"pg": {"money": (19, 4)}, "ms": {"money": (19, 4), "smallmoney": (19, 4)}, "ch": {"uint64": (20, 0)}, "duck": {"hugeint": (38, 0), "ubigint": (20, 0)}}
#: A declared SQLite type by what its name holds, in this order (fixed values).
LITE = (
    (("BOOL",), "Boolean"),
    (("GUID",), "Guid"),
    (("UUID",), "Guid"),
    (("INT",), "Int64"),
    (("DEC",), "Decimal"),
    (("NUM",), "Decimal"),
    (("CLOB",), "Text"),
    (("TEXT",), "Text"),
    (("VAR", "CHAR"), "VarChar"),
    (("CHAR",), "Char"),
    (("BLOB",), "Binary"),
    (("REAL",), "Double"),
    (("FLOA",), "Double"),
    (("DOUB",), "Double"),
    (("DATE",), "DateTime"),
    (("TIME",), "DateTime"),
)
#: How a target writes each canonical type; {n} length, {p},{s} precision and scale; and its warning (fixed values).
TARGETS: dict[str, dict[str, tuple[str, str | None]]] = {
    "pg": {
        "Boolean": ("boolean", None),
        "Int16": ("smallint", None),
        "Int32": ("integer", None),
        "Int64": ("bigint", None),
        "Decimal": ("numeric({p},{s})", None),
        "Single": ("real", None),
        "Double": ("double precision", None),
        "Char": ("character({n})", None),
        "VarChar": ("character varying({n})", None),
        "Text": ("text", None),
        "Date": ("date", None),
        "Time": ("time without time zone", None),
        "DateTime": ("timestamp without time zone", None),
        "DateTimeOffset": ("timestamp with time zone", None),
        "Binary": ("bytea", None),
        "Guid": ("uuid", None),
        "Json": ("jsonb", None),
        "Xml": ("xml", None),
        "Unknown": ("text", "unknown type, kept as text"),
    },
    "my": {
        "Boolean": ("tinyint(1)", "boolean becomes tinyint(1)"),
        "Int16": ("smallint", None),
        "Int32": ("int", None),
        "Int64": ("bigint", None),
        "Decimal": ("decimal({p},{s})", None),
        "Single": ("float", None),
        "Double": ("double", None),
        "Char": ("char({n})", None),
        "VarChar": ("varchar({n})", None),
        "Text": ("text", None),
        "Date": ("date", None),
        "Time": ("time", None),
        "DateTime": ("datetime", None),
        "DateTimeOffset": ("datetime", "the time zone is lost"),
        "Binary": ("longblob", None),
        "Guid": ("char(36)", None),
        "Json": ("json", None),
        "Xml": ("longtext", "XML is kept as text"),
        "Unknown": ("text", "unknown type, kept as text"),
    },
    "ms": {
        "Boolean": ("bit", "boolean becomes bit"),
        "Int16": ("smallint", None),
        "Int32": ("int", None),
        "Int64": ("bigint", None),
        "Decimal": ("decimal({p},{s})", None),
        "Single": ("real", None),
        "Double": ("float", None),
        "Char": ("nchar({n})", None),
        "VarChar": ("nvarchar({n})", None),
        "Text": ("nvarchar(max)", None),
        "Date": ("date", None),
        "Time": ("time", None),
        "DateTime": ("datetime2", None),
        "DateTimeOffset": ("datetimeoffset", None),
        "Binary": ("varbinary(max)", None),
        "Guid": ("uniqueidentifier", None),
        "Json": ("nvarchar(max)", "JSON is kept as text"),
        "Xml": ("xml", None),
        "Unknown": ("nvarchar(max)", "unknown type, kept as text"),
    },
    "ch": {
        "Boolean": ("UInt8", "boolean becomes UInt8"),
        "Int16": ("Int16", None),
        "Int32": ("Int32", None),
        "Int64": ("Int64", None),
        "Decimal": ("decimal({p},{s})", None),
        "Single": ("Float32", None),
        "Double": ("Float64", None),
        "Char": ("FixedString({n})", "short strings are padded"),
        "VarChar": ("String", None),
        "Text": ("String", None),
        "Date": ("Date", None),
        "Time": ("String", "no time of day type, kept as text"),
        "DateTime": ("DateTime", None),
        "DateTimeOffset": ("DateTime", "check the time zone"),
        "Binary": ("String", "binary is kept as text"),
        "Guid": ("UUID", None),
        "Json": ("String", "JSON is kept as text"),
        "Xml": ("String", "XML is kept as text"),
        "Unknown": ("String", "unknown type, kept as text"),
    },
    "duck": {
        "Boolean": ("BOOLEAN", None),
        "Int16": ("SMALLINT", None),
        "Int32": ("INTEGER", None),
        "Int64": ("BIGINT", None),
        "Decimal": ("decimal({p},{s})", None),
        "Single": ("FLOAT", None),
        "Double": ("DOUBLE", None),
        "Char": ("VARCHAR({n})", "lengths aren't fixed"),
        "VarChar": ("VARCHAR({n})", None),
        "Text": ("VARCHAR", None),
        "Date": ("DATE", None),
        "Time": ("TIME", None),
        "DateTime": ("TIMESTAMP", None),
        "DateTimeOffset": ("TIMESTAMPTZ", None),
        "Binary": ("BLOB", None),
        "Guid": ("UUID", None),
        "Json": ("JSON", None),
        "Xml": ("VARCHAR", "XML is kept as text"),
        "Unknown": ("VARCHAR", "unknown type, kept as text"),
    },
    "dm": {
        "Boolean": ("BIT", "boolean becomes BIT"),
        "Int16": ("SMALLINT", None),
        "Int32": ("INTEGER", None),
        "Int64": ("BIGINT", None),
        "Decimal": ("decimal({p},{s})", None),
        "Single": ("BINARY_FLOAT", None),
        "Double": ("BINARY_DOUBLE", None),
        "Char": ("CHAR({n})", None),
        "VarChar": ("VARCHAR2({n})", None),
        "Text": ("CLOB", None),
        "Date": ("DATE", "dates hold a time"),
        "Time": ("TIME", None),
        "DateTime": ("TIMESTAMP(6)", None),
        "DateTimeOffset": ("TIMESTAMP(6) WITH TIME ZONE", None),
        "Binary": ("BLOB", None),
        "Guid": ("VARCHAR(36)", "UUID is kept as text"),
        "Json": ("CLOB", "JSON is kept as text"),
        "Xml": ("CLOB", "XML is kept as text"),
        "Unknown": ("CLOB", "unknown type, kept as text"),
    },
    "lite": {
        "Boolean": ("INTEGER", "boolean becomes 0 or 1"),
        "Int16": ("INTEGER", None),
        "Int32": ("INTEGER", None),
        "Int64": ("INTEGER", None),
        "Decimal": ("NUMERIC", "precision isn't kept"),
        "Single": ("REAL", None),
        "Double": ("REAL", None),
        "Char": ("CHAR({n})", "lengths aren't checked"),
        "VarChar": ("VARCHAR({n})", "lengths aren't checked"),
        "Text": ("TEXT", None),
        "Date": ("DATE", None),
        "Time": ("TIME", None),
        "DateTime": ("DATETIME", None),
        "DateTimeOffset": ("DATETIME", "the time zone is lost"),
        "Binary": ("BLOB", None),
        "Guid": ("TEXT", "UUID is kept as text"),
        "Json": ("TEXT", "JSON is kept as text"),
        "Xml": ("TEXT", None),
        "Unknown": ("TEXT", "unknown type, kept as text"),
    },
}
#: Largest precision and scale, and longest string with what replaces a longer one (fixed values).
MOST_DIGITS = {"my": (65, 30), "ms": (38, 38), "ch": (76, 76), "duck": (38, 38), "dm": (38, 38)}
LONGEST = {"my": (16383, "text"), "ms": (4000, "nvarchar(max)"), "dm": (8188, "CLOB")}
#: What a string without a length becomes (fixed values).
NO_LENGTH = {"pg": "character varying(255)", "my": "varchar(255)", "ms": "nvarchar(255)", "ch": "String", "duck": "VARCHAR", "dm": "VARCHAR2(255)", "lite": "TEXT"}
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_$#]*$"


def lookup(table: Mapping[str, object], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def is_array(native: Column) -> Column:
    name = F.lower(F.btrim(native))
    return name.endswith("[]") | name.startswith("_")


def to_canonical(catalogue: DataFrame, dialect: str) -> DataFrame:
    """catalogue with canonical, c_length, c_precision, c_scale. Declared numbers go before those in the type's text."""
    family, df = FAMILY[dialect], catalogue
    for c in ("length", "precision", "scale"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("int"))
    name = F.lower(F.btrim(F.coalesce(F.col("native_type"), F.lit(""))))
    inner = F.regexp_extract(name, r"\(([^)]*)\)", 1)
    one = F.when(inner.rlike(r"^\s*\d+\s*$"), F.btrim(inner).try_cast("int"))
    first, second = (F.when(inner.rlike(r"^\s*\d+\s*,\s*-?\d+\s*$"), F.btrim(F.split(inner, ",")[k]).try_cast("int")) for k in (0, 1))
    bare = F.btrim(F.regexp_replace(name, r"\(.*$", "")) if family != "pg" else F.btrim(F.regexp_replace(F.replace(name, F.lit("[]"), F.lit("")), r"\(.*$", ""))
    length, precision, scale = F.coalesce("length", one), F.coalesce("precision", first), F.coalesce("scale", second)
    if family == "lite":
        up, kind = F.upper(bare), F.lit("Text")
        for part, canonical in reversed(LITE):
            hit = functools.reduce(Column.__and__, [up.contains(x) for x in part])
            kind = F.when(hit, canonical).otherwise(kind)
        kind = F.when(bare == "", "Binary").when((kind == "Char") & one.isNull(), "Text").otherwise(kind)
        length, precision, scale = one, F.coalesce(first, one), second
    else:
        kind = F.coalesce(lookup({n: k for k, names in NAMES[family].items() for n in names}, bare), F.lit("Unknown"))
        if family == "pg":
            kind = F.when(is_array(name), "Json").otherwise(kind)
        if family == "my":
            kind = F.when((bare == "tinyint") & (one == 1), "Boolean").when((bare == "bit") & (length == 1), "Boolean").otherwise(kind)
        if family == "ms":
            whole = F.btrim(inner) == "max"
            kind = F.when(whole & bare.isin("varchar", "nvarchar"), "Text").otherwise(kind)
            length = F.when(whole, None).otherwise(length)
        if family in OWN_LENGTH:
            length = F.coalesce(lookup(OWN_LENGTH[family], bare), length)
        if family in OWN_DECIMAL:
            own = {n: p for n, (p, _) in OWN_DECIMAL[family].items()}, {n: s for n, (_, s) in OWN_DECIMAL[family].items()}
            precision, scale = F.coalesce(lookup(own[0], bare), precision), F.coalesce(lookup(own[1], bare), scale)
    df = df.withColumn("canonical", kind)
    sized = F.col("canonical").isin("Char", "VarChar") | ((F.col("canonical") == "Binary") & F.lit(family in ("ms", "lite")))
    return df.withColumn("c_length", F.when(sized, length)).withColumn("c_precision", F.when(F.col("canonical") == "Decimal", precision)).withColumn("c_scale", F.when(F.col("canonical") == "Decimal", scale))


def to_target(df: DataFrame, dialect: str) -> DataFrame:
    """df (with canonical and its numbers) with target_type and warnings."""
    family = FAMILY[dialect]
    forms = {k: form for k, (form, _) in TARGETS[family].items()}
    notes = {k: note for k, (_, note) in TARGETS[family].items()}
    kind, n, p, s = F.coalesce("canonical", F.lit("Unknown")), F.col("c_length"), F.col("c_precision"), F.coalesce("c_scale", F.lit(0))
    form, found = lookup(forms, kind), [lookup({k: v for k, v in notes.items() if v} or {"": ""}, kind)]
    decimal, string = kind == "Decimal", kind == "VarChar"
    if family == "pg":
        form = F.when(decimal & p.isNull(), "numeric").otherwise(form)
    elif family == "dm":
        form = F.when(decimal & p.isNull(), "NUMBER").otherwise(form)
    elif family != "lite":
        form = F.when(decimal & p.isNull(), "decimal(18,6)").otherwise(form)
        found.append(F.when(decimal & p.isNull(), "no precision declared, decimal(18,6) is taken"))
    if family in MOST_DIGITS:
        most_p, most_s = MOST_DIGITS[family]
        found.append(F.when(decimal & (p > most_p), f"precision is cut to {most_p}"))
        p = F.least(p, F.lit(most_p))
        if family == "my":
            found.append(F.when(decimal & (s > most_s), f"scale is cut to {most_s}"))
            s = F.least(s, F.lit(most_s))
        found.append(F.when(decimal & p.isNotNull() & (s >= p), "scale is set to precision - 1"))
        s = F.when(s >= p, p - 1).otherwise(s)
    form = F.when(string & n.isNull(), NO_LENGTH[family]).otherwise(form)
    if family in ("pg", "my", "ms", "dm"):
        found.append(F.when(string & n.isNull(), f"no length declared, {NO_LENGTH[family]} is taken"))
    if family == "ch":
        found.append(F.when(string & n.isNotNull(), "the length isn't kept"))
    if family == "lite":
        found[0] = F.when(string & n.isNull(), None).otherwise(found[0])
    if family in LONGEST:
        most, instead = LONGEST[family]
        form = F.when(string & (n > most), instead).otherwise(form)
        found.append(F.when(string & (n > most), f"longer than {most}, becomes {instead}"))
    if family in ("my", "ms"):
        most, small = (65535, "varbinary") if family == "my" else (8000, "varbinary")
        form = F.when((kind == "Binary") & (n <= most), F.concat(F.lit(f"{small}("), n.cast("string"), F.lit(")"))).otherwise(form)
        if family == "my":
            found.append(F.when((kind == "Binary") & (n > most), f"longer than {most}, becomes longblob"))
    for mark, value in (("{n}", F.coalesce(n, F.lit(1))), ("{p}", F.coalesce(p, F.lit(0))), ("{s}", s)):
        form = F.replace(form, F.lit(mark), value.cast("string"))
    return df.withColumn("target_type", form).withColumn("warnings", F.array_compact(F.array(*found)))


def conversion_issues(catalogue: DataFrame, source: str, target: str) -> DataFrame:
    """table, column, level, message: what a conversion of the catalogue's tables loses."""
    df = to_target(to_canonical(catalogue, source), target)
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    row = lambda level, text, when: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(text).alias("message")))
    rules = [row("warning", "the default can't be translated, it is copied as it is", has("default_value").isNotNull() & (has("default_kind") == "unrecognized"))]
    rules.append(row("error", "the expression of the generated column is missing", F.coalesce(has("generated").cast("boolean"), F.lit(False)) & has("generated_expression").isNull()))
    if source != target:
        rules.append(row("warning", "the expression of the generated column is copied as it is", F.coalesce(has("generated").cast("boolean"), F.lit(False)) & has("generated_expression").isNotNull()))
    auto, key = F.coalesce(has("auto_increment").cast("boolean"), F.lit(False)), F.coalesce(has("is_key").cast("boolean"), F.lit(False))
    if FAMILY[target] == "my":
        rules.append(row("warning", "auto increment needs a key column, it is left out", auto & ~key))
    if FAMILY[target] == "lite":
        rules.append(row("error", "auto increment needs a single integer key", auto & ~(key & F.col("canonical").isin("Int16", "Int32", "Int64"))))
    of_type = F.transform("warnings", lambda w: F.struct(F.lit("warning").alias("level"), w.alias("message")))
    return df.select("table", "column", F.explode(F.concat(of_type, F.array_compact(F.array(*rules)))).alias("i")).select("table", "column", "i.level", "i.message")


TYPE = ("native_type", "length", "precision", "scale")  #: what makes a column's type
PROPERTIES = (*TYPE, "nullable", "default_value", "default_kind", "auto_increment", "generated")


def _matched(before: DataFrame, after: DataFrame, name: str, fingerprint: Column, extra: Sequence[str] = ()) -> DataFrame:
    """Full outer match on table and lower-case name, with both fingerprints."""
    side = lambda df, s: df.select(F.col("table"), F.lower(name).alias("_name"), F.col(name).alias(f"{s}_name"), fingerprint.alias(f"{s}_print"), *[F.col(x).alias(f"{s}_{x}") for x in extra])
    return side(before, "b").join(side(after, "a"), ["table", "_name"], "full_outer")


def _prints(df: DataFrame, names: Sequence[str]) -> Column:
    low = lambda c: F.lower(F.col(c).cast("string")) if c == "default_value" else F.col(c).cast("string")
    return _print([low(c) for c in names if c in df.columns])


def _print(parts: Sequence[Column]) -> Column:
    """One text of several, each after its length, so that no two lists have one text."""
    return F.concat(F.lit(""), *[F.when(p.isNull(), "-").otherwise(F.concat(F.char_length(p).cast("string"), F.lit(":"), p)) for p in parts])


def diff_columns(before: DataFrame, after: DataFrame, properties: Sequence[str] = PROPERTIES) -> DataFrame:
    """table, column, change: added, altered or dropped. A property counts if both catalogues have it."""
    both = _matched(before, after, "column", _prints(before, [p for p in properties if p in after.columns]))
    change = F.when(F.col("b_name").isNull(), "added").when(F.col("a_name").isNull(), "dropped").when(F.col("a_print") != F.col("b_print"), "altered")
    return both.select("table", F.coalesce("a_name", "b_name").alias("column"), change.alias("change")).where("change is not null")


def _drop_and_add(both: DataFrame, kind: str) -> DataFrame:
    """A changed definition is a drop and an add."""
    differs = F.col("b_print").isNull() | F.col("a_print").isNull() | (F.col("a_print") != F.col("b_print"))
    steps = F.array_compact(F.array(F.when(F.col("b_name").isNotNull(), "dropped"), F.when(F.col("a_name").isNotNull(), "added")))
    return both.where(differs).select("table", F.coalesce("a_name", "b_name").alias(kind), F.explode(steps).alias("change"))


def diff_indexes(before: DataFrame, after: DataFrame) -> DataFrame:
    """table, index, columns, unique, method, predicate on both sides → table, index, change."""
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    mark = _print([F.array_join(F.transform("columns", lambda c: F.lower(F.btrim(c, F.lit('"` ')))), ","), F.col("unique").cast("string"), text("method"), text("predicate")])
    return _drop_and_add(_matched(before, after, "index", mark), "index")


def diff_fks(before: DataFrame, after: DataFrame) -> DataFrame:
    """table, fk, columns, ref_table, ref_columns, on_delete, on_update on both sides → table, fk, change."""
    low = lambda c: F.array_join(F.transform(c, lambda x: F.lower(x)), ",")
    act = lambda c: F.when(F.btrim(F.coalesce(F.col(c), F.lit(""))) == "", "no action").otherwise(F.lower(c))
    mark = _print([low("columns"), F.lower(F.btrim("ref_table", F.lit('"`'))), low("ref_columns"), act("on_delete"), act("on_update")])
    return _drop_and_add(_matched(before, after, "fk", mark), "fk")


def diff_pk(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables whose sets of key columns differ (rows of is_key), whatever their order."""
    keys = lambda df, n: df.groupBy("table").agg(F.array_sort(F.collect_set(F.when(F.col("is_key"), F.lower("column")))).alias(n))
    both = keys(before, "b").join(keys(after, "a"), "table")
    return both.where("a <> b").select("table", F.array_join("b", ",").alias("key_before"), F.array_join("a", ",").alias("key_after"))


def renames(before: DataFrame, after: DataFrame, most: int = 3) -> DataFrame:
    """Dropped and added columns that may be one renamed: same type and nullability, at most one place apart; nearest first, one to one.

    Tables with more than `most` dropped or added columns have none. Each round takes a table's first pair; there are at most `most`.
    """
    changes = diff_columns(before, after)
    side = lambda df, change, s: changes.where(F.col("change") == change).join(df.select("table", "column", F.col("position").alias(f"{s}_at"), _prints(before, [p for p in TYPE if p in after.columns]).alias("type"), "nullable"), ["table", "column"]).withColumnRenamed("column", s).drop("change")
    dropped, added = side(before, "dropped", "old"), side(after, "added", "new")
    few = changes.groupBy("table").agg(F.count_if(F.col("change") == "dropped").alias("d"), F.count_if(F.col("change") == "added").alias("a")).where(f"d between 1 and {most} and a between 1 and {most}").select("table")
    pairs = dropped.join(few, "table", "left_semi").join(added, ["table", "type", "nullable"]).withColumn("distance", F.abs(F.col("old_at") - F.col("new_at"))).where("distance <= 1")
    # at most `most` squared pairs a table: they fit a row
    listed = pairs.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("distance", "old_at", "new_at", "old", "new"))).alias("left"))
    taken = None
    for _ in range(most):
        first = F.try_element_at("left", F.lit(1))
        listed = listed.withColumn("one", first)
        some = listed.where("one is not null").select("table", "one.old", "one.new", F.when(F.col("one.distance") == 0, "high").otherwise("medium").alias("confidence"))
        taken = some if taken is None else taken.unionByName(some)
        listed = listed.withColumn("left", F.filter("left", lambda x: (x["old"] != F.col("one.old")) & (x["new"] != F.col("one.new"))))
    return taken


Pair = tuple[DataFrame, DataFrame]


def changes(before: DataFrame, after: DataFrame, indexes: Pair | None = None, fks: Pair | None = None, tables: bool = False) -> DataFrame:
    """All column and key changes as steps, with whether a step destroys data (a dropped column, another type or length of it).

    With indexes and foreign keys (before and after, as diff_indexes and diff_fks take them) theirs too. With `tables`, a table that one catalogue lacks is
    created or dropped, which destroys data, as one step in place of its columns'.
    """
    steps = _column_steps(before, after)
    step = lambda df, name, what: df.select("table", F.col(name).alias("object"), F.concat(F.when(F.col("change") == "added", "add_").otherwise("drop_"), F.lit(what)).alias("kind"), F.lit(False).alias("destructive"))
    if indexes:
        steps = steps.unionByName(step(diff_indexes(*indexes), "index", "index"))
    if fks:
        steps = steps.unionByName(step(diff_fks(*fks), "fk", "foreign_key"))
    if tables:
        side = lambda df, name: df.select("table", F.lit(True).alias(name)).distinct()
        whole = side(before, "was").join(side(after, "is"), "table", "full_outer").where("was is null or is is null")
        steps = steps.join(whole.select("table"), "table", "left_anti")
        gone = F.col("is").isNull()
        steps = steps.unionByName(whole.select("table", F.col("table").alias("object"), F.when(gone, "drop_table").otherwise("create_table").alias("kind"), gone.alias("destructive")))
    return steps


def _column_steps(before: DataFrame, after: DataFrame) -> DataFrame:
    types = _matched(before, after, "column", _prints(before, [p for p in TYPE if p in after.columns])).where("a_print <> b_print").select("table", F.col("a_name").alias("column"), F.lit(True).alias("other_type"))
    columns = diff_columns(before, after).join(types, ["table", "column"], "left")
    kind = F.when(F.col("change") == "added", "add_column").when(F.col("change") == "dropped", "drop_column").otherwise("alter_column")
    steps = columns.select("table", F.col("column").alias("object"), kind.alias("kind"), ((F.col("change") == "dropped") | F.coalesce("other_type", F.lit(False))).alias("destructive"))
    if "is_key" in before.columns:
        steps = steps.unionByName(diff_pk(before, after).select("table", F.col("key_after").alias("object"), F.lit("change_key").alias("kind"), F.lit(False).alias("destructive")))
    return steps


def change_counts(before: DataFrame, after: DataFrame, indexes: Pair | None = None, fks: Pair | None = None, tables: bool = False) -> DataFrame:
    return changes(before, after, indexes, fks, tables).groupBy("table").agg(F.count(F.lit(1)).alias("changes"))


def invalid_identifiers(names: DataFrame, column: str) -> DataFrame:
    return names.where(F.col(column).isNull() | ~F.col(column).rlike(IDENTIFIER))


def catalog_columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, column, position, type of each table given."""
    rows = [(t, f.name, k + 1, f.dataType.simpleString()) for t, df in tables.items() for k, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "`table` string, `column` string, position int, type string")


def conform(df: DataFrame, target: DataFrame, renamed: Mapping[str, str] | None = None, drop_confirmed: bool = False) -> tuple[DataFrame, list[str]]:
    """df with the target's columns: missing ones null, others cast, confirmed pairs renamed; columns that the target lacks go only if confirmed."""
    by = {(renamed or {}).get(c, c).lower(): c for c in df.columns}
    out, warnings = [], []
    for f in target.schema.fields:
        c = by.pop(f.name.lower(), None)
        out.append((coerced(F.col(f"`{c}`"), df.schema[c].dataType, f.dataType) if c else F.lit(None).cast(f.dataType)).alias(f.name))
    for c in by.values():
        if not drop_confirmed:
            out.append(F.col(f"`{c}`"))
            warnings.append(f"column {c}: not in the target; it is kept until dropping it is confirmed")
    return df.select(*out), warnings
