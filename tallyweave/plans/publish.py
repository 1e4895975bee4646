"""Published month documents: versioned folders and one manifest that is swapped last.

A month document has several parts (entries with their attachments, bank summary,
reconciliations, fuel records, accounts, counters). A publication writes each part
below a folder of its own; nothing that was published before is touched. Then it writes a
manifest, which names the folder of each part and month, and gives it the next number by
one rename. Readers go through the manifest of the highest number, so all parts and
months of a publication change together; one that fails before the rename leaves the
version before as it was, and publishing again changes nothing but the number.

A month that is named but has no rows is replaced by nothing. A publication of a few
parts (the fuel part and the counters, say) carries the other parts over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallyweave.plans.export import nest_attachments
from tallyweave.plans.monthly import fuel_counters, month_stats
from tallyweave.plans.reports import sum_if

_ROW = "part string, month string, folder string"
_FOLDER = "_m"  # partition column of a part's folder; ``month`` itself stays in the files


@dataclass
class Staged:
    """What a publication has written; invisible until it is committed."""

    months: list[str]
    folders: list[tuple[str, str | None, str]] = field(default_factory=list)


class Publication:
    """Month documents below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._files(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """Numbers of the published versions, oldest first."""
        return sorted(int(n) for n in self._names(f"{self.root}/manifests") if n.isdigit())

    def _manifest(self, version: int | None = None) -> list[tuple[str, str | None, str]]:
        """Rows ``part, month, folder`` of a version (the newest by default); a row without a month holds a part's schema."""
        at = self.versions()[-1:] if version is None else [version]
        if not at:
            return []
        return [tuple(r) for r in self.spark.read.schema(_ROW).json(f"{self.root}/manifests/{at[0]}").collect()]

    def stage(self, parts: dict[str, DataFrame], months: Iterable[str]) -> Staged:
        """Write ``parts``, each with a column ``month``, for ``months``. Rows of other months are refused."""
        staged = Staged(sorted(set(months)))
        for name, df in parts.items():
            folder = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
            known = F.col("month").isin(staged.months) if staged.months else F.lit(False)
            checked = df.withColumn(_FOLDER, F.when(known, F.col("month")).otherwise(
                F.raise_error(F.concat(F.lit(f"{name}: a row of a month that is not published: "), F.coalesce("month", F.lit("null"))))))
            # tasks of even size, however the rows are spread over the months
            checked.hint("rebalance", _FOLDER).write.partitionBy(_FOLDER).parquet(folder)
            staged.folders.append((name, None, json.dumps(df.schema.jsonValue())))
            held = [n for n in self._names(folder) if n.startswith(f"{_FOLDER}=")]
            staged.folders += [(name, n.split("=", 1)[1], f"{folder}/{n}") for n in held]
        return staged

    def commit(self, staged: Staged) -> int:
        """Swap the manifest: the staged parts replace those of their months, all else is carried over."""
        latest = self.versions()[-1:] or [0]
        names = {part for part, month, _ in staged.folders if month is None}
        kept = [r for r in self._manifest() if not (r[0] in names and (r[1] is None or r[1] in staged.months))]
        made = f"{self.root}/manifests/made-{uuid.uuid4().hex}"
        self.spark.createDataFrame(kept + staged.folders, _ROW).coalesce(1).write.json(made)
        number = latest[0] + 1
        fs, target = self._files(f"{self.root}/manifests/{number}")
        if fs.exists(target) or not fs.rename(self._files(made)[1], target):
            raise RuntimeError(f"version {number} was published by another run; publish again")
        return number

    def publish(self, parts: dict[str, DataFrame], months: Iterable[str]) -> int:
        """Stage and commit; returns the version."""
        return self.commit(self.stage(parts, months))

    def months(self, part: str, version: int | None = None) -> list[str]:
        return sorted(m for p, m, _ in self._manifest(version) if p == part and m is not None)

    def read(self, part: str, months: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """Rows of a part; only the folders of ``months`` are opened. A part never published raises."""
        rows = [r for r in self._manifest(version) if r[0] == part]
        schema = next((StructType.fromJson(json.loads(f)) for _, m, f in rows if m is None), None)
        if schema is None:
            raise ValueError(f"no part {part!r} in this version")
        wanted = None if months is None else set(months)
        paths = [f for _, m, f in rows if m is not None and (wanted is None or m in wanted)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def drop_old(self, keep: int = 2) -> int:
        """Delete all versions but the last ``keep`` and the folders only they use; returns the folders deleted."""
        held = self.versions()
        used = {f for v in held[-keep:] for _, m, f in self._manifest(v) if m is not None}
        gone = {f for v in held[:-keep] for _, m, f in self._manifest(v) if m is not None} - used
        for path in [*(f"{self.root}/manifests/{v}" for v in held[:-keep]), *gone]:
            fs, p = self._files(path)
            fs.delete(p, True)
        return len(gone)


def month_parts(
    ledger: DataFrame, attachments: DataFrame, fiscal: DataFrame, recon: DataFrame, banks: DataFrame, chart: DataFrame,
    fuel_records: DataFrame, months: list[str],
) -> dict[str, DataFrame]:
    """The parts of the documents of ``months``. A fuel record belongs to the month of its date; undated ones to none."""
    of = lambda df, column="month": df.where(F.col(column).isin(months))
    entries = of(ledger)
    ids = entries.select("entry_id", "month")
    fuel = of(fuel_records.withColumn("month", F.date_format("doc_date", "yyyy-MM")))
    per_bank = entries.join(banks.select("bank_account_id", "coa_code"), "bank_account_id").groupBy("month", "bank_account_id").agg(
        sum_if(F.col("debit_account") == F.col("coa_code")).alias("inflow"), sum_if(F.col("credit_account") == F.col("coa_code")).alias("outflow"),
        F.count("*").alias("n"), F.count_if(F.col("status") == "manual_review").alias("pending"))
    return {
        "entries": nest_attachments(entries, attachments),
        "summary": per_bank,
        "reconciliations": recon.join(entries.select("tx_id", "month"), "tx_id"),
        "fuel_records": fuel,
        "accounts": chart.withColumn("month", F.explode(F.array(*[F.lit(m) for m in months]))),
        "stats": of(month_stats(entries, attachments.join(ids.select("entry_id"), "entry_id", "left_semi"), fiscal, recon, fuel)),
    }


def fuel_parts(publication: Publication, fuel_records: DataFrame, months: list[str]) -> dict[str, DataFrame]:
    """The fuel part anew, and the published counters with its two figures: what a rescan of the fuel folder changes."""
    fuel = fuel_records.withColumn("month", F.date_format("doc_date", "yyyy-MM")).where(F.col("month").isin(months))
    counted = fuel_counters(fuel).select("month", F.col("fuel_documents").alias("_d"), F.col("fuel_linked").alias("_l"))
    old = publication.read("stats", months)
    new = old.join(counted, "month", "full_outer").withColumns({"fuel_documents": F.coalesce("_d", F.lit(0)), "fuel_linked": F.coalesce("_l", F.lit(0))})
    return {"fuel_records": fuel, "stats": new.na.fill(0).select(*old.columns)}

