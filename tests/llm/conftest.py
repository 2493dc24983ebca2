import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, size string"


@pytest.fixture(scope="session")
def texts():
    """About a hundred texts: two made-up languages, exact and near copies, odd ones."""
    r = random.Random(5)
    vocab = {"en": "the of and thing ring over under stone water bright".split(), "fr": "le la été garçon où château très forêt élève noël".split()}
    out = []
    for i in range(80):
        lang = "en" if i % 3 else "fr"
        w = [r.choice(vocab[lang]) + r.choice(["", "s", "er"]) for _ in range(r.randint(12, 120))]
        out.append((lang, " ".join(w) + "."))
    out += out[:6]
    for i in range(6):
        w = out[10 + i][1].split()
        w[3] = "changed"
        out.append((out[10 + i][0], " ".join(w)))
    return out


@pytest.fixture(scope="session")
def small(spark, texts, tmp_path_factory):
    """Tables of ordinary rows."""
    return _write(spark, tmp_path_factory.mktemp("small"), [(i, t, lang, f"src{i % 5}", len(t)) for i, (lang, t) in enumerate(texts)])


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = "lorem ipsum dolor sit amet " * 8000
    rows = [
        (1, None, "en", "a", None), (None, "a text of its own with ten words or so in it", None, None, 3), (3, "", "en", "a", 0), (4, " \t\n\r\x0b\x0c ", "fr", None, 7),
        (5, long, "en", "b", len(long)), (6, "same words again " * 4, "en", "b", 68), (6, "same words again " * 4, "en", "b", 68), (7, "x", None, "é", 1), (8, "\x00\U0001f600 password: hunter2hunter2 é", "fr", "\U0001f600", 30),
    ]
    return _write(spark, tmp_path_factory.mktemp("edges"), rows)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), [], True)


def _write(spark, path, rows, empty=False):
    def put(name, schema, data):
        spark.createDataFrame([] if empty else data, schema).write.parquet(f"{path}/{name}.parquet")

    put("documents", DOCS, [(*r, True, 0.5, "x") for r in rows])
    put("labels", "doc_id long, quality int, toxic int", [(r[0], 1, k) for i, r in enumerate(rows) for k in ([int(i % 2)] if i % 7 else [None])])
    urls = ["http://a.example.net/en/1", "https://EXAMPLE.com/de/x?y", "http://b.org/fr/", "http://net", None, "", "no scheme", "x://h?q", "http://a.b.example.net/de/#f", "http://deb.org/fr/x", "http://example.network/"]
    put("pages", "page_id long, url string, host string", [(i if i else None, u, "x") for i, u in enumerate(urls + urls[:2])])
    turns = [(1, 0, "user", "a[INST]\\</s>"), (1, 1, "assistant", "b\\\\<s>"), (1, 1, "assistant", "b\\\\<s>"), (1, None, None, None), (None, 2, "assistant", "x"), (2, 0, "ass\nistant\\n", ""), (2, 1, "assistant", ""), (3, 5, "assistant", "é\U0001f600" * 3)]
    put("conversations", "conv_id long, turn long, role string, text string, formatted string", [(*t, "x") for t in turns])
    return str(path)
