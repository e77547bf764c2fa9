import random

import pyarrow.parquet as pq

from slotwise.llm import decontamination


def test_a_task_reads_few_blocks_of_the_index_at_once(spark):
    """Spark keeps a whole row group of blocks in memory, so groups stay small in a long file."""
    draw = random.Random(1)
    vocabulary = [f"w{draw.randrange(10**9)}" for _ in range(30_000)]
    texts = [" ".join(draw.choices(vocabulary, k=120_000)) for _ in range(16)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = decontamination.build_index(docs)
    assert index.count() == 4
    metas = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i) for m in metas for i in range(m.num_row_groups)]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) < 2 * decontamination.GROUP_BYTES
    item = " ".join(texts[7].split()[500:510])
    found = decontamination.find_passages(index, spark.createDataFrame([(3, item)], "item_id long, text string"))
    hits = [(r.doc_id, r.spans[0].a, r.spans[0].b) for r in found.filter("item_id = 3").collect()]
    assert hits == [(7, 500, 510)]
