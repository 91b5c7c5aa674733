"""What the executors hold on behalf of Python workers is bounded, whatever stages ran before."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tailwright.llm import common
from tailwright.llm.minhash_dedup import dedup_documents
from tailwright.llm.mixing import mix_documents
from tailwright.llm.packing import pack_documents
from tailwright.llm.quality_rules import quality_rules
from tailwright.llm.tokens import default_path
from tailwright.llm.toxicity import State, fit, score_toxicity

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def _model():
    model = State.fresh(1).model()
    model.thresholds = {None: 0.5}
    return model


STEPS = {
    "fit": lambda docs: fit(docs, docs.select("doc_id", F.lit(1).alias("toxic"))),
    "toxicity": lambda docs: score_toxicity(docs, _model()),
    "rules": quality_rules,
    "dedup": dedup_documents,
    "mixing": mix_documents,
    "packing": lambda docs: pack_documents(docs, default_path("word_bpe_49k.json")),
}


def _largest(spark) -> int:
    """Bytes of the largest batch that 12 MB of texts in one partition, of less than 10,000 rows, come in."""
    sizes = spark.range(0, 9000, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 1400)).alias("text"))
    run = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    return max(r.n for r in sizes.mapInArrow(run, "n long").collect())


@pytest.mark.parametrize("step", STEPS)
def test_workers_get_small_batches(spark, no_docs, step):
    before = spark.conf.get(CONF)
    try:
        spark.conf.unset(CONF)
        assert _largest(spark) > 2 * common.ARROW_BYTES
        STEPS[step](no_docs)
        assert _largest(spark) <= common.ARROW_BYTES + 4096
        spark.conf.set(CONF, str(1 << 20))  # a smaller bound of the session's own stays
        common.small_batches(spark)
        assert _largest(spark) <= (1 << 20) + 4096
    finally:
        spark.conf.set(CONF, before)


def test_a_task_gives_back_what_the_last_one_held(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a", "b", "c"]})
    assert [p.num_rows for p in common.pieces(iter([batch]), rows=2)] == [2, 1] and calls == [1]
