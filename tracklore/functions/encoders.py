"""Text encoders (V3, V4). One encoder serves both stored texts and questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tracklore import fixed_values as fx


def hashing_encoder(width: int = fx.VECTOR_WIDTH) -> Callable[[DataFrame, str, str], DataFrame]:
    """Offline default: unit-length hashed word counts, computed in the JVM.

    Deterministic and without a model file; distances reflect shared words only.
    """

    def encode(rows: DataFrame, text: str, out: str) -> DataFrame:
        words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}.]+")
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=width)
        unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
        encoded = unit.transform(counts.transform(words.transform(rows)))
        return encoded.withColumn(out, vector_to_array("_unit", "float32")).drop(
            "_words", "_counts", "_unit"
        )

    return encode


def model_encoder(
    load: Callable[[], Callable], batch_size: int = fx.ENCODER_BATCH
) -> Callable[[DataFrame, str, str], DataFrame]:
    """Encoder around a user's model.

    ``load`` runs once per Python worker and returns a function from an array of texts
    to a 2-D array of vectors, which is then fed batches of ``batch_size`` texts.
    """
    predict = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch_size)

    def encode(rows: DataFrame, text: str, out: str) -> DataFrame:
        return rows.withColumn(out, predict(F.col(text)))

    return encode


def encode_question(spark, question: str, encoder) -> list[float]:
    """The vector of one question, through the same encoder as stored texts."""
    row = encoder(spark.createDataFrame([(question,)], "text string"), "text", "embedding").first()
    return list(row["embedding"])
