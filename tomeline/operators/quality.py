"""Data quality as tables of findings: ``dataset, row_ord, severity, rule, message``.

Checks never raise. A row's checks are an array of messages in the row itself; checks across
rows are aggregates and joins on the id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeline.functions import text as tx

DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
ISO_TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T"
SEMVER = r"\A[0-9]+\.[0-9]+\.[0-9]+\z"
CHAPTER_H1 = r"\A#\s+[0-9]{3}\."


def findings(df: DataFrame, dataset: str, rule: str, message: Column, severity: str = "error") -> DataFrame:
    """Findings of the rows whose message is not NULL."""
    return df.filter(message.isNotNull()).select(
        F.lit(dataset).alias("dataset"),
        F.col("row_ord"),
        F.lit(severity).alias("severity"),
        F.lit(rule).alias("rule"),
        message.alias("message"),
    )


def findings_of_each(df: DataFrame, dataset: str, rule: str, messages: list[Column], severity: str = "error") -> DataFrame:
    """Findings of several checks of a row in one pass; a NULL message is no finding."""
    one = df.select("row_ord", F.explode(F.array_compact(F.array(*messages))).alias("message"))
    return findings(one, dataset, rule, F.col("message"), severity)


def row_findings(df: DataFrame, dataset: str, checks: dict[str, Column]) -> DataFrame:
    """Findings of all rules that look at one row, in one pass over the table.

    ``checks`` maps a rule to an array of messages; NULL messages are no findings.
    """

    def named(rule: str, messages: Column) -> Column:
        return F.transform(F.array_compact(messages), lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("message")))

    found = F.concat(*[named(rule, messages) for rule, messages in checks.items()])
    each = df.select("row_ord", F.explode(found).alias("f"))
    return each.select(F.lit(dataset).alias("dataset"), "row_ord", F.lit("error").alias("severity"), "f.rule", "f.message")


def required_messages(fields: list[str]) -> list[Column]:
    return [F.when(F.col(f).isNull(), F.lit(f"missing field: {f}")) for f in fields]


def required_fields(df: DataFrame, dataset: str, fields: list[str]) -> DataFrame:
    return findings_of_each(df, dataset, "required", required_messages(fields))


def kind_message(field: str, kind: str) -> Column:
    """For datasets of a single kind, which every row must name as it is written."""
    return F.when(~F.col(field).eqNullSafe(kind), F.lit(f"{field} should be {kind}"))


def date_message(field: str, allow_time: bool) -> Column:
    raw = tx.strip(tx.text_or_empty(F.col(field)))
    fine = raw.rlike(DATE) | raw.rlike(ISO_TIME) if allow_time else raw.rlike(DATE)
    return F.when(raw == "", F.lit(f"{field} is empty")).when(
        ~fine, F.concat(F.lit(f"{field} has invalid date format: "), raw)
    )


def dates(df: DataFrame, dataset: str, fields: list[str], allow_time: bool = True) -> DataFrame:
    return findings_of_each(df, dataset, "date", [date_message(f, allow_time) for f in fields])


def unique_ids(df: DataFrame, dataset: str, field: str = "id") -> DataFrame:
    """Empty ids, and every row after the first one of its id.

    Ids are counted before rows meet: only ids that occur twice come back to the table, so a
    single id that fills the table is one small row on the other side of the join.
    """
    return findings(df, dataset, "unique_id", empty_message(field)).unionByName(repeated_ids(df, dataset, field))


def empty_message(field: str) -> Column:
    return F.when(tx.strip(tx.text_or_empty(F.col(field))) == "", F.lit(f"{field} is empty"))


def repeated_ids(df: DataFrame, dataset: str, field: str = "id") -> DataFrame:
    """Every row after the first one of its id, blank ids apart."""
    rows = df.select("row_ord", tx.strip(tx.text_or_empty(F.col(field))).alias("key"))
    counted = rows.filter("key <> ''").groupBy("key").agg(
        F.min("row_ord").alias("first_ord"), F.count("*").alias("n")
    )
    again = rows.join(counted.filter("n > 1"), "key").filter("row_ord > first_ord")
    return findings(again, dataset, "unique_id", F.concat(F.lit(f"duplicate {field}: "), F.col("key")))


def allowed_values(df: DataFrame, dataset: str, field: str, allowed: list[str]) -> DataFrame:
    return findings(df, dataset, "kind", unsupported_message(field, allowed))


def unsupported_message(field: str, allowed: list[str]) -> Column:
    value = F.lower(tx.text_or_empty(F.col(field)))
    return F.when(~value.isin(allowed), F.concat(F.lit(f"unsupported {field}: "), value))


def conditional_fields(df: DataFrame, dataset: str, kind: str, needs: dict[str, str]) -> DataFrame:
    """Rows of a kind that lack the field this kind needs; ``needs`` maps kind to field."""
    return findings_of_each(df, dataset, "conditional", conditional_messages(kind, needs))


def conditional_messages(kind: str, needs: dict[str, str]) -> list[Column]:
    value = F.lower(tx.text_or_empty(F.col(kind)))
    return [
        F.when((value == k) & (tx.strip(tx.text_or_empty(F.col(f))) == ""), F.lit(f"{kind}={k} requires {f}"))
        for k, f in needs.items()
    ]


def foreign_key(df: DataFrame, dataset: str, field: str, parents: DataFrame, parent_field: str = "id") -> DataFrame:
    """Rows whose value is not blank and not an id of the parent table."""
    rows = df.select("row_ord", tx.strip(tx.text_or_empty(F.col(field))).alias("key")).filter("key <> ''")
    known = parents.select(tx.strip(tx.text_or_empty(F.col(parent_field))).alias("key")).distinct()
    message = F.concat(F.lit(f"{field} not found: "), F.col("key"))
    return findings(rows.join(known, "key", "left_anti"), dataset, "foreign_key", message)


def files_present(df: DataFrame, dataset: str, field: str, files: DataFrame) -> DataFrame:
    """Rows without a file name, and rows whose file is not listed in ``files.file``."""
    rows = df.select("row_ord", tx.text_or_empty(F.col(field)).alias("file"))
    unnamed = findings(rows, dataset, "file", F.when(F.col("file") == "", F.lit(f"{field} is empty")))
    return unnamed.unionByName(files_gone(df, dataset, field, files))


def files_gone(df: DataFrame, dataset: str, field: str, files: DataFrame) -> DataFrame:
    """Rows whose file is not listed in ``files.file``."""
    rows = df.select("row_ord", tx.text_or_empty(F.col(field)).alias("file"))
    missing = rows.filter("file <> ''").join(files.select("file").distinct(), "file", "left_anti")
    return findings(missing, dataset, "file", F.concat(F.lit(f"{field} missing: "), F.col("file")))


def line_lint(df: DataFrame, dataset: str, content: str) -> DataFrame:
    """Lines that make a chapter a first-level heading."""
    return row_findings(df, dataset, {"line_lint": lint_messages(content)})


def lint_messages(content: str) -> Column:
    lines = F.split(tx.plain_breaks(tx.text_or_empty(F.col(content))), "\n")
    said = F.lit("chapter heading should be h2 (##), not h1 (#): line ")
    return F.transform(
        lines, lambda line, i: F.when(tx.strip(line).rlike(CHAPTER_H1), F.concat(said, (i + 1).cast("string")))
    )


def metadata(df: DataFrame, dataset: str) -> DataFrame:
    """Warnings on ``data_version, generated_at, source``."""
    version, made, source = (tx.strip(tx.text_or_empty(F.col(c))) for c in ("data_version", "generated_at", "source"))
    missing = "missing recommended metadata: "
    checks = [
        F.when(version == "", F.lit(missing + "data_version")).when(
            ~version.rlike(SEMVER), F.concat(F.lit("data_version should use semver, got: "), version)
        ),
        F.when(made == "", F.lit(missing + "generated_at")).when(
            ~made.rlike(ISO_TIME), F.concat(F.lit("generated_at should be an ISO time, got: "), made)
        ),
        F.when(source == "", F.lit(missing + "source")),
    ]
    return findings_of_each(df, dataset, "metadata", checks, "warning")


def dataset_counts(datasets: dict[str, DataFrame]) -> DataFrame:
    """Row count of each dataset; every dataset is counted by itself, none is dropped."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("dataset"), "n") for k, df in datasets.items()]
    return reduce(DataFrame.unionByName, counts)


def non_empty(datasets: dict[str, DataFrame]) -> DataFrame:
    rows = dataset_counts(datasets).withColumn("row_ord", F.lit(0).cast("bigint"))
    message = F.when(F.col("n") == 0, F.concat(F.col("dataset"), F.lit(" is empty")))
    return rows.filter(message.isNotNull()).select(
        "dataset", "row_ord", F.lit("error").alias("severity"), F.lit("non_empty").alias("rule"), message.alias("message")
    )


def missing_media(items: DataFrame, url: str, name: str, order: str, examples: int = 5) -> DataFrame:
    """Rows, rows without media, and the first few names of those.

    The examples come from a top-k, so that no task ever holds all missing rows.
    """
    absent = tx.text_or_empty(F.col(url)) == ""
    total = items.agg(F.count("*").alias("total"), F.count_if(absent).alias("missing"))
    shown = items.filter(absent).select(F.col(order).alias("o"), F.col(name).alias("n")).orderBy("o").limit(examples)
    in_order = F.array_sort(F.collect_list(F.struct("o", "n")))
    sample = shown.agg(F.array_join(F.transform(in_order, lambda s: s["n"]), ", "))
    return total.withColumn("examples", sample.scalar())


def declared_count(declared: DataFrame, datasets: dict[str, DataFrame]) -> DataFrame:
    """Datasets whose declared ``dataset, count`` differs from the rows they have."""
    joined = declared.join(dataset_counts(datasets), "dataset")
    return joined.filter(~F.col("count").eqNullSafe(F.col("n"))).select(
        "dataset", F.col("count").alias("declared"), F.col("n").alias("actual")
    )


def name_coverage(names: DataFrame, items: DataFrame) -> DataFrame:
    """Number of items of each listed name, 0 for a name no item has."""
    per_name = items.groupBy(tx.match_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"))
    listed = names.select("name", tx.match_key(F.col("name")).alias("key"))
    return listed.join(per_name, "key", "left").select("name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def normalize_report(changes: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Changed rows and rows of each dataset; a value is ``(df, before, after)`` columns."""
    parts = [
        df.agg(
            F.count_if(~F.col(before).eqNullSafe(F.col(after))).alias("changed"), F.count("*").alias("total")
        ).select(F.lit(name).alias("dataset"), "changed", "total")
        for name, (df, before, after) in changes.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def broken_links(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Local links of ``page_path, html`` pages that lead to no known ``path``.

    External, mail, in-page and blank links are left out and the query part is dropped. A link
    is tried from the site root, from the page's folder, and from the root once more with its
    leading dots removed.
    """
    href = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))))
    local = (
        pages.select("page_path", href.alias("href"))
        .filter(~F.col("href").rlike(r"\A(https?://|mailto:|#)"))
        .withColumn("target", F.substring_index("href", "?", 1))
        .filter("target <> ''")
    )
    bare = tx.sub(F.col("target"), r"\A[./]+")
    folder = tx.sub(F.col("page_path"), r"[^/]*\z")
    beside = F.when(F.startswith("target", F.lit("/")), tx.sub(F.col("target"), r"\A/+")).otherwise(
        _resolve_dots(F.concat(folder, F.col("target")))
    )
    tried = local.select(
        "page_path", "href", F.explode(F.array_distinct(F.array(_as_file(beside), _as_file(bare)))).alias("path")
    )
    good = tried.join(known.select("path").distinct(), "path", "left_semi").select("page_path", "href").distinct()
    return local.select("page_path", "href").join(good, ["page_path", "href"], "left_anti").distinct()


def _as_file(path: Column) -> Column:
    return tx.sub(path, r"/+\z", "")


def _resolve_dots(path: Column) -> Column:
    """Path without ``.`` and ``..`` steps."""
    none = F.array().cast("array<string>")
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        steps,
        none,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.array_append(acc, s)
        ),
    )
    return F.array_join(kept, "/")
