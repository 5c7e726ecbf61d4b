"""Connected components of links between ids, by least labels and pointer jumping.

Every round is joins and grouped minima over written tables, so a hub is a key of a join that Spark
can split or of a sum that is combined before it is shuffled; nothing comes to the driver but the
number of labels that changed.  Ids may be of any ordered type; repeated links and links of an id to itself change
nothing; no links give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written


def components(links: DataFrame) -> DataFrame:
    """A written table with (id, root) of every id in ``links`` (a, b): root is the least id that it reaches."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("seen"))
        lower = labels.select("id", "root").join(seen, "id").select("id", F.col("root").alias("old"), F.least("root", "seen").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("root").alias("far"))
        found = written(lower.join(jump, "near", "left").select("id", "old", F.least("near", F.coalesce("far", "near")).alias("root")), "labels")
        done = found.filter("root < old").isEmpty()
        discard(labels)
        labels = found
        if done:
            discard(both)
            return labels
