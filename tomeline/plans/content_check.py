"""Normalise, index and validate the content datasets, in this order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.functions import text as tx
from tomeline.operators import lines as ln
from tomeline.operators import quality as dq
from tomeline.plans.search_index import search_docs
from tomeline.plans.updates_feed import updates_feed


def normalize_documents(df: DataFrame, kind: str) -> DataFrame:
    """Documents with tidy content and a new summary; ``before`` keeps the old content."""
    kept = df.withColumn("before", tx.text_or_empty(F.col("content")))
    tidy = kept.withColumn("content", ln.promote_headings(F.col("before"), kind))
    return tidy.withColumn("summary", tx.summary(F.col("content")))


def validate(datasets: dict[str, DataFrame], files: DataFrame | None = None, metadata: dict[str, DataFrame] | None = None) -> DataFrame:
    """Findings of all schema rules on normalised datasets.

    Each dataset is read once for all rules that look at one row; only repeated ids, references, files and
    counts read a column or two again. ``files`` lists the ``file`` that exist (None: not looked at);
    ``metadata`` holds a dataset's metadata row (None: not looked at), whose faults are warnings.
    """
    rows = {k: df.withColumn("row_ord", F.col("ord").cast("bigint")) for k, df in datasets.items()}
    found = [dq.repeated_ids(rows[name], name) for name in ("faqs", "errata", "pages", "links")]
    for name, kind in (("faqs", "faq"), ("errata", "errata")):
        fields = ["kind", "id", "title", "summary", "content", "source", "published_at", "origin_url", "updated_at"]
        found.append(
            dq.row_findings(
                rows[name],
                name,
                {
                    "required": F.array(*dq.required_messages(fields)),
                    "unique_id": F.array(dq.empty_message("id")),
                    "kind": F.array(dq.kind_message("kind", kind)),
                    "date": F.array(*[dq.date_message(f, True) for f in ("published_at", "updated_at")]),
                },
            )
        )
    found.append(
        dq.row_findings(
            rows["pages"],
            "pages",
            {
                "required": F.array(*dq.required_messages(["kind", "id", "title", "summary", "file", "updated_at"])),
                "unique_id": F.array(dq.empty_message("id")),
                "kind": F.array(dq.kind_message("kind", "rule_page")),
                "date": F.array(dq.date_message("updated_at", False)),
                "file": F.array(F.when(tx.text_or_empty(F.col("file")) == "", F.lit("file is empty"))),
                "line_lint": dq.lint_messages("content"),
            },
        )
    )
    found.append(
        dq.row_findings(
            rows["links"],
            "links",
            {
                "required": F.array(*dq.required_messages(["id", "title", "kind", "summary", "source", "updated_at"])),
                "unique_id": F.array(dq.empty_message("id")),
                "date": F.array(dq.date_message("updated_at", False)),
                "kind": F.array(dq.unsupported_message("kind", ["page", "pdf", "external"])),
                "conditional": F.array(
                    *dq.conditional_messages("kind", {"page": "page_id", "pdf": "url", "external": "url"})
                ),
            },
        )
    )
    found.append(dq.foreign_key(rows["links"].filter(F.lower("kind") == "page"), "links", "page_id", rows["pages"]))
    if files is not None:
        found.append(dq.files_gone(rows["pages"], "pages", "file", files))
    for name, row in (metadata or {}).items():
        found.append(dq.metadata(row.withColumn("row_ord", F.lit(0).cast("bigint")), name))
    found.append(dq.non_empty(datasets))
    return reduce(DataFrame.unionByName, found)


def content_check(
    datasets: dict[str, DataFrame], files: DataFrame | None = None, metadata: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Tables of one run over ``faqs, errata, pages, links, items``; ``files, metadata`` as in :func:`validate`.

    ``report`` counts changed rows, ``search_docs`` and ``updates`` are the indexes of the
    normalised content, ``findings`` lists every fault. A caller publishes the indexes only
    when ``findings`` holds no error.
    """
    tidy = {
        "faqs": normalize_documents(datasets["faqs"], "faq"),
        "errata": normalize_documents(datasets["errata"], "errata"),
        "pages": normalize_documents(datasets["pages"], "page"),
    }
    report = dq.normalize_report({k: (df, "before", "content") for k, df in tidy.items()})
    items = tx.clean_fields(
        datasets["items"], ["name", "set", "rarity", "ability_text"], ["domains", "card_types", "super_types", "tags"]
    )
    counted = items.agg(F.coalesce(F.sum("changed"), F.lit(0)).cast("bigint").alias("changed"), F.count("*").alias("total"))
    report = report.unionByName(counted.select(F.lit("items").alias("dataset"), "changed", "total"))
    whole = {**tidy, "links": datasets["links"], "items": items}
    return {
        "report": report,
        "search_docs": search_docs(tidy["pages"], tidy["faqs"], tidy["errata"], datasets["links"], items),
        "updates": updates_feed(tidy["faqs"], tidy["errata"], datasets["links"], tidy["pages"]),
        "findings": validate(whole, files, metadata),
    }
