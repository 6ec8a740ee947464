"""Character TF-IDF: packed rows lie in row groups of bounded size, so a reader's batch is bounded too."""

import glob

import pyarrow.parquet as pq

from textlake.operators import ngrams as N
from textlake.session import checkpoint_dir


def test_packed_rows_lie_in_small_row_groups(spark):
    """400 texts of 30,000 grams in one file: before, one row group and one batch held them all."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    folder = checkpoint_dir(spark).removeprefix("file:").rstrip("/")
    old = set(glob.glob(f"{folder}/grams-*"))
    docs = spark.createDataFrame([(i, "".join(chr(97 + (i * 7 + j * j) % 26) + str(j % 977) for j in range(1500))) for i in range(400)], "k long, t string")
    n = N.char_tfidf(docs, "k", "t", 3, 7).groupBy("k").count().count()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    (made,) = set(glob.glob(f"{folder}/grams-*")) - old
    groups = [m.row_group(i) for m in (pq.read_metadata(f) for f in glob.glob(f"{made}/*.parquet")) for i in range(m.num_row_groups)]
    assert n == 400 == sum(g.num_rows for g in groups)
    assert max(g.total_byte_size for g in groups) < 4 * N.GRAM_GROUP and len(groups) > 3
