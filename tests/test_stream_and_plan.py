from pyspark.sql import functions as F

from samewise.config import Decision, ErConfig
from samewise.functions.normalize import prepare
from samewise.plans import resolve as R
from samewise.streaming.pool_stream import candidates_of_stream

SCHEMA = "entity_id string, business_name string, business_address string, country string"
S1 = [("S1-1", "Acme Tools Corporation", "45th Street, Boston, 02110", "US"), ("S1-2", "Sharma & Sons Pvt Ltd", "12 MG Road, Karnataka 560001", "India"), ("S1-3", "Lonely Traders LLC", "", "US")]
POOL = [("S2-1", "ACME TOOLS CORP.", "45 Street Boston 02110", "US"), ("S3-1", "Tools Acme", "Boston", "US"), ("S2-2", "Sharma and Sons Private Limited", "MG Rd 12, 560001", "India"), ("S3-2", "Société Générale de Café", "3 rue du Quai, 75001", "France"), ("S3-3", "www.acmetools.com", "", "US")]


def test_resolve_small_registry(spark):
    index, pool = (prepare(spark.createDataFrame(x, SCHEMA)) for x in (S1, POOL))
    cfg = ErConfig(max_df=1.0, decision=Decision("thr", 0.2))
    lists = {r.s1: set(r.ids) for r in R.resolve(index, pool, cfg=cfg).collect()}
    assert "S2-1" in lists["S1-1"] and lists["S1-2"] == {"S2-2"} and set(lists) == {"S1-1", "S1-2", "S1-3"}
    rerank = {r.s1: set(r.ids) for r in R.resolve(index, pool, cfg=ErConfig(max_df=1.0, rerank="full", decision=Decision("ef"))).collect()}
    assert set(rerank) == set(lists)


def test_stream_equals_batch(spark, tmp_path):
    index = prepare(spark.createDataFrame(S1, SCHEMA)).cache()
    spark.createDataFrame(POOL, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = candidates_of_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "ck"), max_df=1.0)
    query.awaitTermination(120)
    found = {(r.s1, r.cand) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = R.candidates(index, prepare(spark.createDataFrame(POOL, SCHEMA)), ErConfig(max_df=1.0))
    assert found == {(r.s1, r.cand) for r in batch.select(F.col("s1"), F.col("cand")).collect()} and found
