"""Rows that every operator has to take: nulls, empty, long, tied and repeated ones."""

LONG = " ".join(f"w{n % 7919}x{n % 13}" for n in range(60_000)) + "\n" + "z" * 70_000
TEXTS = ["one two three four", "", None, "one two three four", LONG, "  \t ", "#### </turn> \\",
         "naïve 中文 ▁ text\n\nwith lines", "one two three four"]
# Names that the operators add or use themselves.
CLASHING = ("size", "kept", "score", "ids", "fingerprint", "target", "n_tokens", "deduped",
            "keep_id", "component_id", "predicted", "rank", "taken", "pseudonymised", "copies",
            "_id", "_winner", "_size", "_runs", "_run_doc", "_key", "_of", "_whole", "_chance", "_rank",
            "_bucket", "_cut", "_copy", "_found", "_sized", "_cards", "_finds", "_pieces", "_me", "_print",
            "_known", "_digest", "_trusted", "_label_key", "prefix", "digest", "text_sha256")


def edge_documents(spark):
    rows = [(i, t, None if i == 3 else "en", None if i % 4 == 3 else f"src{i % 2}",
             None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, "one two three four", None, None, None), (None, None) + (None,) * 3]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for name in CLASHING:
        docs = docs.selectExpr("*", f"'mine' AS `{name}`")
    return docs


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
