"""Values derived from names, types, risks and priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srclens.functions.conditions import ladder

#: SQL type to (ORM type, script type). An unknown type is a varchar and string.
SQL_TYPES = {
    "tinyint(1)": ("boolean", "boolean"),
    "tinyint": ("tinyint", "number"), "smallint": ("smallint", "number"), "mediumint": ("mediumint", "number"), "int": ("int", "number"),
    "integer": ("int", "number"), "bigint": ("bigint", "string"), "serial": ("int", "number"), "bigserial": ("bigint", "string"),
    "float": ("float", "number"), "double": ("double", "number"), "real": ("real", "number"), "decimal": ("decimal", "string"), "numeric": ("decimal", "string"),
    "boolean": ("boolean", "boolean"), "bool": ("boolean", "boolean"), "bit": ("bit", "boolean"),
    "char": ("char", "string"), "varchar": ("varchar", "string"), "tinytext": ("tinytext", "string"), "text": ("text", "string"),
    "mediumtext": ("mediumtext", "string"), "longtext": ("longtext", "string"),
    "binary": ("binary", "Buffer"), "varbinary": ("varbinary", "Buffer"), "tinyblob": ("tinyblob", "Buffer"), "blob": ("blob", "Buffer"),
    "mediumblob": ("mediumblob", "Buffer"), "longblob": ("longblob", "Buffer"), "bytea": ("bytea", "Buffer"),
    "date": ("date", "string"), "time": ("time", "string"), "datetime": ("datetime", "Date"), "timestamp": ("timestamp", "Date"), "year": ("year", "number"),
    "json": ("json", "object"), "jsonb": ("jsonb", "object"),
    "enum": ("enum", "string"), "set": ("set", "string"), "uuid": ("uuid", "string"),
}


def sql_type(type_: Column) -> tuple[Column, Column]:
    """ORM and script type of a column type such as ``tinyint(1)`` or ``BIGINT(20)``."""
    t = F.lower(F.trim(type_))
    base = F.regexp_extract(t, r"^([a-z]+)", 1)
    pick = lambda k: F.when((base == "tinyint") & F.contains(t, F.lit("(1)")), SQL_TYPES["tinyint(1)"][k]).otherwise(
        ladder([(base == n, v[k]) for n, v in SQL_TYPES.items() if "(" not in n], ("varchar", "string")[k])
    )
    return pick(0), pick(1)


#: Script types of PHP types; others keep their name.
PHP_TYPES = {
    "int": "number", "integer": "number", "float": "number", "double": "number", "string": "string", "bool": "boolean", "boolean": "boolean",
    "array": "any[]", "object": "Record<string, any>", "mixed": "any", "void": "void", "null": "null",
}


def php_type(type_: Column) -> Column:
    """Script type of a PHP type: nullable ``?T``, unions ``A|B``, arrays ``T[]`` and ``array<T>``; classes keep their name."""

    def one(t: Column) -> Column:
        inner = F.regexp_replace(t, r"^(array<)+|>+(\[\])*$|(\[\])+$", "")
        depth = F.regexp_count(t, F.lit(r"\[\]")) + F.regexp_count(t, F.lit("array<"))
        return F.concat(ladder([(F.lower(inner) == k, v) for k, v in PHP_TYPES.items()], inner), F.repeat(F.lit("[]"), depth))

    t = F.trim(type_)
    parts = F.split(F.when(F.startswith(t, F.lit("?")), F.concat(F.substring(t, 2, 1000), F.lit("|null"))).otherwise(t), r"\|")
    return F.array_join(F.transform(parts, lambda x: one(F.trim(x))), " | ")


def sample_value(name: Column, type_: Column) -> Column:
    """An example value by name, else by type."""
    n, t = F.lower(name), F.lower(type_)
    has = lambda w: F.contains(n, F.lit(w))
    return ladder(
        [(has("email"), "user@example.com"), (has("phone"), "+1-555-0100"), (has("date"), "2024-01-01"), (has("price") | has("amount"), "9.99"), (has("name"), "Example"),
         (has("url"), "https://example.com"), (n.rlike("(^|_)id$"), "1"), (t.isin("int", "integer", "number"), "1"), (t.isin("float", "double"), "1.5"),
         (t.isin("bool", "boolean"), "true"), (F.startswith(t, F.lit("array")), "[]")],
        "example",
    )


def validators(name: Column, type_: Column, required: Column) -> Column:
    """Validator names in order."""
    t = F.lower(type_)
    checks = [
        (required, "IsNotEmpty"), (~required, "IsOptional"), (t.isin("int", "integer"), "IsInt"), (t.isin("float", "double", "number"), "IsNumber"),
        (t == "string", "IsString"), (t.isin("bool", "boolean"), "IsBoolean"), (F.startswith(t, F.lit("array")), "IsArray"),
        (F.contains(F.lower(name), F.lit("email")), "IsEmail"), (F.contains(F.lower(name), F.lit("url")), "IsUrl"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(v)) for c, v in checks]), lambda x: x.isNotNull())


def endpoint_priority(name: Column, calls: Column, is_hot: Column) -> Column:
    n = F.lower(name)
    return ladder(
        [(F.contains(n, F.lit("auth")) | F.contains(n, F.lit("login")), "critical"), (is_hot | (calls >= 20), "high"), (calls >= 5, "normal")], "low"
    )


#: Factor of the base timeout of 5000 ms by priority, retries and breaker threshold.
TIMEOUT_FACTOR = {"critical": 0.5, "high": 1.0, "normal": 1.5, "low": 2.0}
RETRIES = {"critical": 5, "high": 3, "normal": 3, "low": 1}


def timeout_ms(priority: Column, uses_database: Column) -> Column:
    base = ladder([(priority == k, int(5000 * f)) for k, f in TIMEOUT_FACTOR.items()], 5000)
    return (base + F.when(uses_database, 2000).otherwise(0)).cast("long")


def retries(priority: Column) -> Column:
    return ladder([(priority == k, v) for k, v in RETRIES.items()], 3).cast("long")


def resilience(priority: Column, is_hot: Column) -> Column:
    """Retry, breaker and fallback settings of an endpoint: critical ones fail fast."""
    critical = priority == "critical"
    pick = lambda a, b: F.when(critical, a).otherwise(b).cast("long")
    return F.struct(
        (~critical).alias("retry_enabled"), pick(2, 3).alias("max_attempts"), pick(50, 100).alias("initial_delay_ms"), pick(3, 5).alias("failure_threshold"),
        pick(15000, 30000).alias("breaker_timeout_ms"), (~critical).alias("fallback_enabled"), F.when(is_hot, "cache").otherwise("error").alias("fallback"),
    )


def service_name(path: Column) -> Column:
    """The last part of a module's path in snake case and ``_service``."""
    from srclens.functions.naming import snake

    return F.concat(snake(F.element_at(F.split(path, "/"), -1)), F.lit("_service"))


def entity_name(table: Column) -> Column:
    """The capitalised parts of a table's name."""
    return F.array_join(F.transform(F.split(table, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), "")
