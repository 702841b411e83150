"""Small tables with the awkward cases every operator must take."""

import public_tokenizers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **extra):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def real_texts(spark, sf, n=120):
    return [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n).collect()]


def odd_texts():
    return [None, "", " ", "\n\n", "a", "a", "word", "  two  blanks\t\ttab\r\nline hard em", "x\n\ny \n z", " lead", "trail ",
            "<|endoftext|> in<|endoftext|>side", "don't it's 12345 ٣٤ é é", "\x1c\x1d odd\x85line　end", "the end\n",
            "lóng " * 3000, "日本語のテキスト 漢字", "🙂 emoji 🙂🙂", "A" * 5000]


def vocabulary(name):
    return public_tokenizers.path(name)
