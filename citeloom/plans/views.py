"""Corpus-shaped views over the given tables, as DataFrames and as SQL.

The tables hold no case law, so opinions, courts, citation edges, anchors,
citation strings and parentheticals are derived by modular arithmetic. Operators
take frames of these shapes; the views are only one source of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..tables import fingerprint, kept, written

#: Contexts of anchors by l_suppkey mod 8.
CONTEXTS = (
    "was overruled by a later decision",
    "abrogated in part on other grounds",
    "but see the dissent",
    "declined to follow that reasoning",
    "distinguishing the facts at hand",
    "as stated in the opinion",
    "citing with approval",
    "no longer good law after the amendment",
)
REPORTERS = ("U.S.", "F.2d", "F.3d", "S. Ct.", "F. Supp.")


@dataclass
class Corpus:
    """The views of one folder of tables."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    @cached_property
    def state(self) -> str:
        """A fingerprint of the tables' files: what is kept of them is kept under it."""
        return fingerprint(self.spark, self.sf_dir)

    @cached_property
    def size(self) -> int:
        return self.table("documents").count()

    @property
    def opinions(self) -> DataFrame:
        i = F.col("doc_id")
        return self.table("documents").select(
            i.alias("id"),
            F.floor(i / 3).alias("cluster_id"),
            F.concat(F.lit("n"), (i % 25).cast("string")).alias("court_id"),
            F.when(i % 3 == 0, "020lead").when(i % 3 == 1, "040dissent").otherwise("010combined").alias("type"),
            F.when(i % 11 == 0, "Unpublished").when(i % 11 == 1, "Unknown").otherwise("Published").alias("status"),
            (i % 5 == 0).alias("ocr"),
            (i % 13 == 0).alias("blocked"),
            F.date_add(F.lit("2000-01-01").cast("date"), (i * 37 % 9500).cast("int")).alias("date_filed"),
            "text",
        )

    @property
    def courts(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return n.select(
            F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
            F.col("n_name").alias("name"),
            F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"),
        ).union(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), "r_name", F.lit(None).cast("string")))

    @property
    def citation_map(self) -> DataFrame:
        return self._map_rows.groupBy("citing_id", "cited_id").agg(F.min("depth").alias("depth"))

    @property
    def anchors(self) -> DataFrame:
        return self._anchor_rows.distinct()

    @property
    def cited_pairs(self) -> DataFrame:
        """(citing_id, cited_id) of the map and of the anchors, which are the pairs of their cites, as often as the tables have them."""
        key = ["citing_id", "cited_id"]
        return self._map_rows.select(key).unionByName(self._anchor_rows.select(key))

    @property
    def edges(self) -> DataFrame:
        """(src, dst): the distinct pairs whose ends exist. The map has a row for each line, the anchors one for each second."""
        return graph.edges(self.cited_pairs, self.opinions, self.table("lineitem").count() * 3 // 2)

    @cached_property
    def written_edges(self) -> DataFrame:
        """``edges`` as a table, made once in an application, for what reads them several times."""
        return kept(self.spark, ("edges", self.state), lambda: written(self.edges, "edges"))

    @property
    def contexts(self) -> DataFrame:
        """(cited_id, context) of the anchors as often as the tables have them: every anchor is a cite and no other cite has a context."""
        return self._anchor_rows.select("cited_id", "context")

    @property
    def _map_rows(self) -> DataFrame:
        n = self.size
        return self.table("lineitem").select(
            (F.col("l_orderkey") % n).alias("citing_id"),
            ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % (n + n // 100)).alias("cited_id"),
            F.col("l_linenumber").cast("long").alias("depth"),
        )

    @property
    def _anchor_rows(self) -> DataFrame:
        n = self.size
        context: Column = F.lit(CONTEXTS[-1])
        for k, phrase in reversed(list(enumerate(CONTEXTS[:-1]))):
            context = F.when(F.col("l_suppkey") % 8 == k, phrase).otherwise(context)
        return (
            self.table("lineitem")
            .where("l_orderkey % 2 = 0")
            .select(
                (F.col("l_orderkey") % n).alias("citing_id"),
                ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % n).alias("cited_id"),
                (F.col("l_partkey") % 1000).alias("char_pos"),
                context.alias("context"),
            )
        )

    @property
    def citation_strings(self) -> DataFrame:
        o = self.table("orders")
        place = F.substring("o_orderpriority", 1, 1).cast("int") - 1
        return o.select(
            (F.col("o_orderkey") % (self.size // 3)).alias("cluster_id"),
            (F.col("o_custkey") % 200).cast("string").alias("volume"),
            F.get(F.array(*map(F.lit, REPORTERS)), place).alias("reporter"),
            (F.col("o_orderkey") % 500).cast("string").alias("page"),
        )

    @property
    def parentheticals(self) -> DataFrame:
        n = self.size
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 7 % n).alias("described_id"), ((F.col("conv_id") * 11 + F.col("turn")) % n).alias("describing_id"), "text"
        )

    @property
    def statutes(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("id"), F.when(k % 2 == 0, "usc").otherwise("ecfr").alias("source"), (k % 50 + 1).cast("string").alias("title"), k.cast("string").alias("section"),
            F.col("p_name").alias("heading"), F.concat_ws(" ", "p_type", "p_brand").alias("text"),
        )


_CASES = " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CONTEXTS))
_REPORTERS = ", ".join(f"'{r}'" for r in REPORTERS)

#: The views as common table expressions; a query continues with ``, name AS (...) SELECT`` or ``SELECT``.
VIEWS = f"""WITH size AS (SELECT count(*) AS n FROM documents),
opinions AS (SELECT doc_id AS id, doc_id // 3 AS cluster_id, 'n' || (doc_id % 25) AS court_id,
  CASE doc_id % 3 WHEN 0 THEN '020lead' WHEN 1 THEN '040dissent' ELSE '010combined' END AS type,
  CASE doc_id % 11 WHEN 0 THEN 'Unpublished' WHEN 1 THEN 'Unknown' ELSE 'Published' END AS status,
  doc_id % 5 = 0 AS ocr, doc_id % 13 = 0 AS blocked, DATE '2000-01-01' + (doc_id * 37 % 9500)::INT AS date_filed, text FROM documents),
courts AS (SELECT 'n' || n_nationkey AS id, n_name AS name, 'r' || n_regionkey AS parent_id FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region),
citation_map AS (SELECT l_orderkey % n AS citing_id, (l_partkey * 7 + l_suppkey) % (n + n // 100) AS cited_id, min(l_linenumber)::BIGINT AS depth
  FROM lineitem, size GROUP BY 1, 2),
anchors AS (SELECT DISTINCT l_orderkey % n AS citing_id, (l_partkey * 7 + l_suppkey * 3) % n AS cited_id, l_partkey % 1000 AS char_pos,
  CASE l_suppkey % 8 {_CASES} END AS context FROM lineitem, size WHERE l_orderkey % 2 = 0),
citation_strings AS (SELECT o_orderkey % (n // 3) AS cluster_id, (o_custkey % 200)::VARCHAR AS volume,
  [{_REPORTERS}][substr(o_orderpriority, 1, 1)::INT] AS reporter, (o_orderkey % 500)::VARCHAR AS page FROM orders, size),
statutes AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'usc' ELSE 'ecfr' END AS source, (p_partkey % 50 + 1)::VARCHAR AS title, p_partkey::VARCHAR AS section,
  p_name AS heading, p_type || ' ' || p_brand AS text FROM part),
parentheticals AS (SELECT conv_id * 1000 + turn AS id, conv_id * 7 % n AS described_id, (conv_id * 11 + turn) % n AS describing_id, text FROM conversations, size),
cites AS (SELECT m.citing_id, m.cited_id, m.depth, a.char_pos, a.context FROM citation_map m LEFT JOIN anchors a USING (citing_id, cited_id)
  UNION ALL SELECT a.citing_id, a.cited_id, NULL, a.char_pos, a.context FROM anchors a ANTI JOIN citation_map m USING (citing_id, cited_id)),
edges AS (SELECT DISTINCT citing_id AS src, cited_id AS dst FROM cites WHERE citing_id IN (SELECT id FROM opinions) AND cited_id IN (SELECT id FROM opinions))
"""
