"""Signed links against the standard library; deletes keep the rest of a store."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import functions as F

from ravine.operators import providers


def test_signatures(spark):
    for secret in ("k", "a longer secret " * 9, "ü"):
        df = spark.createDataFrame([("a/images/1.png",), ("",), ("ü",)], "key string")
        rows = df.select("key", providers.hmac_sha256(F.col("key"), secret).alias("d"), providers.signed_url(F.lit("u"), F.col("key"), secret, F.lit(100), 50).alias("url"))
        for r in rows.collect():
            assert r["d"] == hmac.new(secret.encode(), r["key"].encode(), hashlib.sha256).hexdigest()
            assert r["url"] == f"u?expires=150&signature={hmac.new(secret.encode(), (r['key'] + chr(10) + '150').encode(), hashlib.sha256).hexdigest()}"
        held = rows.select(*(providers.is_signed(u, k, s, F.lit(n)).alias(c) for c, u, k, s, n in (("ok", F.col("url"), F.col("key"), secret, 150), ("late", F.col("url"), F.col("key"), secret, 151), ("other", F.col("url"), F.lit("x"), secret, 1), ("secret", F.col("url"), F.col("key"), secret + "!", 1), ("odd", F.lit("u?expires=&signature="), F.col("key"), secret, 1)))).collect()
        assert all(tuple(r) == (True, False, False, False, False) for r in held)


def test_deletes(spark, tmp_path):
    rows = [(f"{d}/images/page_0001_{i:03d}.png", b"x") for d in "abc" for i in range(3)]
    providers.write_objects(spark.createDataFrame(rows, "key string, content binary"), str(tmp_path / "one"))
    left, counts = providers.delete_objects(spark, str(tmp_path / "one"), str(tmp_path / "two"), spark.createDataFrame([("a",), ("a",), ("zz",)], "doc string"))
    assert sorted(r["key"] for r in left.collect()) == [k for k, _ in rows if k[0] != "a"]
    assert {r["doc"]: r["deleted"] for r in counts.collect()} == {"a": 3, "zz": 0}
