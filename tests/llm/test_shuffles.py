"""How many texts the stages of the pipeline send over the network, and that no row is lost for it."""

from collections import Counter

import pytest

from framegauge.llm import blob_ledger, simhash
from framegauge.storage import new_path

SECRET = "password = abcdefghijklmnop"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def texts_shuffled(df) -> int:
    """Rows with a text that all exchanges of a collected frame wrote."""
    found, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif kind == "ShuffleExchangeExec":
            columns = [node.output().apply(k) for k in range(node.output().size())]
            # A partial aggregate carries the text under another name.
            if any(c.dataType().simpleString() == "string" and c.name() != "_blob" for c in columns):
                found += node.metrics().apply("shuffleRecordsWritten").value()
        nodes.extend(node.children().apply(k) for k in range(node.children().size()))
    return found


def test_near_duplicates_deal_each_text_once(spark, no_broadcast):
    rows = [(k, f"text number {k} of words {k * k} unlike {k * 77} any {k ** 3} other") for k in range(40)]
    rows += [(None, "a b c d e f"), (None, "a b c d e f"), (None, "q w e r t y u"), (7, rows[7][1]), (90, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.keep_one(docs)
    kept = Counter(tuple(r) for r in found.collect())
    assert kept == Counter({row: 1 for row in rows if row != (90, rows[7][1])})
    assert 0 < texts_shuffled(found) <= len(rows)


def test_redaction_deals_only_texts_with_a_match(spark, no_broadcast):
    rows = [(k, f"plain text {k}", 5) for k in range(30)]
    rows += [(40, SECRET, 27), (41, "token: short", 12), (42, None, None), (None, f"{SECRET}!", 28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    found = blob_ledger.redact(spark, docs, new_path(spark, "ledger"))
    changed = {40: (40, "[assign]", 8), None: (None, "[assign]!", 9)}
    assert Counter(tuple(r) for r in found.collect()) == Counter(changed.get(r[0], r) for r in rows)
    assert found.schema == docs.schema
    assert texts_shuffled(found) == 3
