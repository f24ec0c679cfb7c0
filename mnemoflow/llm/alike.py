"""Problem 4: texts that print alike but differ in their characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from mnemoflow.llm.fold import fold_array
from mnemoflow.session import checkpoint_dir


@arrow_udf(T.StringType())
def _folded(text: pa.Array) -> pa.Array:
    return fold_array(text)


def one_form(text: Column) -> Column:
    """The one form of a text column.

    Width forms, composed and separate accents, ligatures, invisible characters, kinds of space, line
    ends and look-alike letters or radicals become one; case, accents, digits, superscripts and the
    number of blanks and line breaks stay. Null stays null, an empty text stays empty, and a text that
    consists of invisible characters only becomes empty.
    """
    return _folded(text)


def alike_variants(values: DataFrame, salt_rows: int = 20_000) -> DataFrame:
    """Ids of the records whose text has a different spelling elsewhere in the same field.

    ``values``: field, id, text; other columns are ignored. Gives field, form (key of the one form), spelling
    (key of the exact text), id and salt, a number below the number of parts that a spelling of many
    records is cut into. Nulls take no part; an id that comes more than once counts once for each spelling.
    Only fixed-size keys are shuffled, never texts; counts are combined before they are shuffled.
    """
    keyed = (
        values.select("field", "id", "text")
        .where(F.col("text").isNotNull() & F.col("id").isNotNull())
        .select("field", "id", F.unhex(F.md5(one_form(F.col("text")))).alias("form"), F.unhex(F.md5("text")).alias("spelling"))
    )
    checkpoint_dir(values.sparkSession)
    keyed = keyed.checkpoint()  # read twice below; 40 bytes a value, against folding every text again
    spellings = keyed.groupBy("field", "form", "spelling").agg(F.count("*").alias("n"))
    several = (
        spellings.groupBy("field", "form")
        .agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi"))
        .where("lo <> hi")
        .select("field", "form")
    )
    kept = spellings.join(several, ["field", "form"], "left_semi").withColumn("parts", F.ceil(F.col("n") / salt_rows))
    return keyed.distinct().join(kept, ["field", "form", "spelling"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")))


def alike_pairs(values: DataFrame, salt_rows: int = 20_000) -> DataFrame:
    """Pairs of different records that print alike but aren't equal: field, id_lo, id_hi.

    The pairs are formed between the spellings of a form first, which are few, and only then between
    their records; a spelling of many records is cut into parts, each joined by itself.
    """
    members = alike_variants(values, salt_rows)
    # few of all values are left: those that have another spelling
    parts = members.select("field", "form", "spelling", "salt").distinct()
    other = parts.select("field", "form", F.col("spelling").alias("spelling_b"), F.col("salt").alias("salt_b"))
    pairs = parts.join(other, ["field", "form"]).where(F.col("spelling") < F.col("spelling_b"))
    left = members.select("field", "form", "spelling", "salt", F.col("id").alias("a"))
    right = members.select("field", "form", F.col("spelling").alias("spelling_b"), F.col("salt").alias("salt_b"), F.col("id").alias("b"))
    return (
        pairs.join(left, ["field", "form", "spelling", "salt"])
        .join(right, ["field", "form", "spelling_b", "salt_b"])
        .where("a <> b")
        .select("field", F.least("a", "b").alias("id_lo"), F.greatest("a", "b").alias("id_hi"))
    )


def alike_classes(values: DataFrame) -> DataFrame:
    """One row per record with a look-alike that differs: field, id, class, spelling, copies, records.

    class is the least id of the form, spelling numbers its spellings from 1 in the order of their least ids, copies are the records of the same spelling and
    records those of the form. Null texts have no row; a form of any number of records is one row each, never their pairs.
    """
    members = alike_variants(values)
    spellings = members.groupBy("field", "form", "spelling").agg(F.countDistinct("id").alias("copies"), F.min("id").alias("_least"))
    forms = Window.partitionBy("field", "form")
    numbered = spellings.withColumn("spelling_no", F.row_number().over(forms.orderBy("_least", "spelling"))).withColumn("records", F.sum("copies").over(forms)).withColumn("class", F.min("_least").over(forms))
    rows = members.select("field", "form", "spelling", "id").join(numbered, ["field", "form", "spelling"])
    return rows.select("field", "id", "class", F.col("spelling_no").alias("spelling"), "copies", "records")


def alike_report(values: DataFrame) -> DataFrame:
    """Per field: values, values that differ from their one form, forms, and forms with several spellings."""
    keyed = (
        values.select("field", "text")
        .where(F.col("text").isNotNull())
        .select("field", F.md5(one_form(F.col("text"))).alias("form"), F.md5("text").alias("spelling"))
    )
    spellings = keyed.groupBy("field", "form", "spelling").agg(F.count("*").alias("n"))
    forms = spellings.groupBy("field", "form").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.when(F.col("form") != F.col("spelling"), F.col("n")).otherwise(0)).alias("odd")
    )
    return forms.groupBy("field").agg(
        F.sum("n").alias("values"), F.sum("odd").alias("changed"), F.count("*").alias("forms"), F.count_if(F.col("k") > 1).alias("forms_spelled_several_ways")
    )
