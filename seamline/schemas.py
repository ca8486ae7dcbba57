"""Schemas of the tables and documents exchanged with users."""

from pyspark.sql import types as T

SPAN = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("first_character_index", T.LongType()),
        T.StructField("last_character_index", T.LongType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("extension", T.StringType(), False),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("start_index", T.LongType()),
        T.StructField("end_index", T.LongType()),
        T.StructField("file_path", T.StringType()),
    ]
)

#: Answered and unanswered questions share one schema; the fields of the answer are null where it is missing.
QUESTION = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("sources", T.ArrayType(SPAN)),
    ]
)

QUESTION_FILE = T.StructType([T.StructField("rag_questions", T.ArrayType(QUESTION))])

RESULT = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("question_str", T.StringType()),
        T.StructField("retrieved_sources", T.ArrayType(SPAN)),
        T.StructField("answer", T.StringType()),
    ]
)

RESULT_FILE = T.StructType([T.StructField("search_results", T.ArrayType(RESULT)), T.StructField("k", T.IntegerType())])
