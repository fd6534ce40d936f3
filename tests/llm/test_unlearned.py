"""Texts in languages and scripts that were never learned, among clean ones."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from foliant.llm import language_id

from fixtures import documents

SF = "/root/testdata/sf0.001"
FOREIGN = [
    "漢字", "日本語の文章は読みにくいです。漢字も多い。", "Η γρήγορη αλεπού πηδά πάνω από τον τεμπέλη σκύλο", "ภาษาไทยไม่มีช่องว่าง",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu."]


def test_planted_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    planted = documents(spark, [(10**6 + i, t, None, "planted") for i, t in enumerate(FOREIGN)]).select(*P.COLUMNS)
    kept = {r["doc_id"] for r in P.known_language(spark, docs.unionByName(planted), SF).collect()}
    assert not {i for i in kept if i >= 10**6}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"])}


@pytest.mark.parametrize("left_out", ["fr", "es"])
def test_a_language_without_labels_goes(spark, left_out):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    unlabelled = docs.withColumn("lang", F.when(F.col("lang") != left_out, F.col("lang")))
    kept = {r["doc_id"] for r in P.known_language(spark, unlabelled, SF).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if r["lang"] != left_out and any(c.isalpha() for c in r["text"])}


def test_confidence_of_mixed_scripts_is_their_share(spark):
    model = language_id.fit(documents(spark, [(i, "hello the world and all that is in it", "en", "s") for i in range(8)]))
    found = language_id.identify(documents(spark, [(1, "hello 漢字漢字漢", None, None), (2, "hello the world", None, None), (3, "12 !", None, None)]), model)
    got = {r["doc_id"]: r["confidence"] for r in found.collect()}
    assert got[1] == pytest.approx(0.5, abs=0.03) and got[2] > 0.9 and got[3] == 0
