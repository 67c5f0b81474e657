"""Several tables that are written as one.

Rows of all tables belong to an owner (a trip, say), and a save replaces all that given owners have in the
tables it names. It writes the rows of each table under its number, over that partition
alone, and last of all a row for each owner and table that says so; until then readers see
nothing of it. A save that is run again writes the same partitions anew. What a later save replaced is hidden, and
compacted() leaves it behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved

#: Of all tables' rows that of their owner, of their save, and the table that says which save counts.
OWNER, SAVE, COMMITS = "owner", "save", "commits"


@dataclass
class TableStore:
    """Tables by name, each with the schema of its columns beside the owner, in a folder."""

    spark: SparkSession
    path: str
    owner_type: str
    schemas: dict[str, str]

    def _read(self, table: str, schema: str) -> DataFrame:
        schema = f"{OWNER} {self.owner_type}, {schema}, {SAVE} int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # nothing stored yet
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, table: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/{SAVE}={number}")  # an empty one, too, takes away what an earlier try left

    def _counting(self, upto: int | None = None) -> DataFrame:
        """owner, table and the save whose rows count."""
        commits = self._read(COMMITS, "name string")
        if upto is not None:
            commits = commits.where(F.col(SAVE) < upto)
        return commits.groupBy(OWNER, "name").agg(F.max(SAVE).alias(SAVE))

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """The rows of a table that count now, or did before a save, with their owner."""
        known = self._counting(before).where(F.col("name") == table).drop("name")
        return self._read(table, self.schemas[table]).join(known, [OWNER, SAVE], "left_semi").drop(SAVE)

    def save(self, number: int, parts: dict[str, DataFrame], owners: DataFrame | None = None) -> None:
        """Replaces all rows of some owners in the tables of `parts` by those given there; an owner without rows in one of them has none afterwards.

        owners has their ids, all owners of the rows in parts if it isn't given. Numbers rise from save to save; the same
        number again replaces what it wrote. Rows of a null owner can't be stored and are refused.
        """
        rows = {table: saved(part.select(OWNER, *self._columns(table))) for table, part in parts.items()}
        for table, part in rows.items():
            if not part.where(F.col(OWNER).isNull()).isEmpty():
                raise ValueError(f"rows of {table} without {OWNER}")
        if owners is None:
            for part in rows.values():
                owners = part.select(OWNER) if owners is None else owners.union(part.select(OWNER))
        owners = saved(owners.select(OWNER).distinct())
        for table, part in rows.items():
            self._write(part.join(owners, OWNER, "left_semi"), table, number)
        commits = owners.select(OWNER, F.explode(F.array(*[F.lit(x) for x in parts])).alias("name"))
        self._write(commits, COMMITS, number)

    def delete(self, number: int, owners: DataFrame) -> None:
        """Takes the owners with all that belongs to them out of all tables at once."""
        commits = owners.select(OWNER).distinct().select(OWNER, F.explode(F.array(*[F.lit(x) for x in self.schemas])).alias("name"))
        self._write(saved(commits), COMMITS, number)

    def removed_by(self, number: int) -> DataFrame:
        """name and rows: how many rows of each table a save took out of sight."""
        out = None
        touched = self._read(COMMITS, "name string").where(F.col(SAVE) == number).drop(SAVE)
        for table in self.schemas:
            gone = self.read(table, number).join(touched.where(F.col("name") == table).select(OWNER), OWNER, "left_semi")
            rows = gone.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("name"), "rows")
            out = rows if out is None else out.unionByName(rows)
        return out

    def compacted(self, path: str) -> TableStore:
        """A store in another folder with the rows that count now, as its save 0."""
        new = TableStore(self.spark, path, self.owner_type, self.schemas)
        new.save(0, {table: self.read(table) for table in self.schemas})
        return new

    def _columns(self, table: str) -> list[str]:
        return [field.name for field in self.spark.createDataFrame([], self.schemas[table]).schema]
