"""Maps and columns with the operators' own names, and lengths after redaction."""

from framegauge.llm import blob_ledger, packing, simhash
from framegauge.storage import new_path

SECRET = "token = abcdefghij0123456789"
NAMES = "_blob string, _findings int, _before int, _after int, _id int, _row int, _group int, _bin int, _open int"


def test_maps_and_clashing_names(spark):
    texts = ["plain", f"x {SECRET}", f"{SECRET} and {SECRET}", None, "plain"]
    rows = [(k, t, len(t or ""), {"a": k}, "b", *[1] * 8) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, n_chars long, m map<string,int>, {NAMES}")
    redacted = blob_ledger.redact(spark, docs, new_path(spark, "ledger"))
    assert redacted.columns == docs.columns
    found = {r.doc_id: r for r in redacted.collect()}
    assert all(r.n_chars == len(r.text or "") for r in found.values())
    assert "abcdefghij" not in (found[1].text + found[2].text) and found[3].text is None
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("text = 'plain'").count() == 1
    pieces = docs.selectExpr("doc_id as id", "cast(1 as long) as length", "m", *[n.split()[0] for n in NAMES.split(", ")])
    packed = packing.pack_pieces(pieces, capacity=3).collect()
    assert len(packed) == 5 and len({r.sequence_id for r in packed}) == 2
