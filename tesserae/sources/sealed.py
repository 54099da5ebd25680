"""Encrypted documents: AES-GCM envelopes of whole documents, bound to collection and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ID = "id"


def _bound(name: str) -> Column:
    return F.concat(F.lit(f"{name}/"), F.col(ID))


def seal(df: DataFrame, name: str, key: bytes) -> DataFrame:
    """id and box, all on the JVM: the JSON of each document under a fresh nonce."""
    nonce = F.unhex(F.substring(F.sha2(F.concat(F.expr("uuid()"), F.expr("uuid()")), 256), 1, 24))
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(ID, F.aes_encrypt(body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce, _bound(name)).alias("box"))


def unseal(boxes: DataFrame, name: str, key: bytes, schema: str | StructType) -> DataFrame:
    """The documents; a wrong key, or a box of another document or collection, gives no row."""
    body = F.try_aes_decrypt(F.col("box"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _bound(name)).cast("string")
    return boxes.select(F.from_json(body, schema).alias("d")).where("d is not null").select("d.*")
