"""What Python workers keep of the pipeline's operators."""

import pyarrow as pa
from pyspark import SparkContext

from quillmill.llm import bpe, packing, quality, queries, rangecoder, workspace


def test_other_work_drops_the_encoders(spark, odd):
    def keep(batches):
        for b in batches:
            workspace.works_for("token ids", bpe.forget)
            bpe.library_encoder(queries.BYTE_BPE)
            yield b

    def then(batches):
        list(batches)
        workspace.works_for("other work")
        yield pa.RecordBatch.from_pydict({"n": [bpe.encoder.cache_info().currsize + bpe.library_encoder.cache_info().currsize]})

    packing.pack(odd.repartition(4), queries.BYTE_BPE).collect()
    # the second runs in workers that have packed
    assert {r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(then, "n long").collect()} == {0}
    spark.range(0, 8, 1, 4).mapInArrow(keep, "id long").collect()
    assert {r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(then, "n long").collect()} == {0}


def test_library_waits_for_an_added_token():
    plain = bpe.LibraryEncoder(queries.BYTE_BPE)
    plain.encode(["no added token", None, ""])
    assert "library" not in vars(plain)
    assert plain.encode(["a<|endoftext|>"])[0].tolist()[-1] == 50256 and "library" in vars(plain)
    assert plain.added == [t.content for t in plain.library.get_added_tokens_decoder().values()]


def test_small_tables_start_no_pool_of_their_own(spark, odd, none, monkeypatch):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "doc_id long, quality int").localCheckpoint()
    odd, none = odd.localCheckpoint(), none.localCheckpoint()

    def no_rdd(*args, **kwargs):
        raise AssertionError("rows of the driver went through an RDD")

    monkeypatch.setattr(SparkContext, "parallelize", no_rdd)
    assert packing.pack(odd, queries.BYTE_BPE).count() >= odd.count()
    assert packing.pack(none, queries.BYTE_BPE).count() == 0
    assert quality.train(odd, labels).good is not None


def test_id_files_start_no_pool_of_their_own(spark, odd, tmp_path, monkeypatch):
    odd = odd.localCheckpoint()

    def no_rdd(*args, **kwargs):
        raise AssertionError("rows of the driver went through an RDD")

    monkeypatch.setattr(SparkContext, "parallelize", no_rdd)
    manifest = rangecoder.write_files(odd, queries.BYTE_BPE, f"file://{tmp_path}/a")
    assert rangecoder.read_files(manifest, f"file://{tmp_path}/a").count() == odd.count()


def test_new_slices_copy_no_old_ones():
    e = bpe.Encoder(bpe.encoder(queries.BYTE_BPE).vocabulary)
    e.encode([" ".join(map(str, range(5000)))])
    spans, pool, rows = e.spans, e.pool, e.table.rows
    want = [x.tolist() for x in e.encode(["some 4999 others", "", "4999"])]
    assert e.table.rows == rows + 3 and e.spans is spans and e.pool is pool
    e.encode([" ".join(map(str, range(5000, 60_000)))])
    assert len(e.spans) >= e.table.rows and [x.tolist() for x in e.encode(["some 4999 others", "", "4999"])] == want
