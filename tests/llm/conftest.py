import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null, empty, blank, very long, tied and repeated rows, with extra columns whose names clash."""
    prose = " ".join(f"word{i} so{i * 3} on{i % 7}" for i in range(60))
    texts = {
        1: None, 2: "", 3: " \t\n ", 4: prose, 5: prose, 6: prose + " tail", 7: prose.replace(" ", "\n\t ", 3),
        8: "x" * 50_000, 9: "long words here " * 20_000, 10: "short", 11: "short", 12: "émoji 😀 \x00 ▁▁ ﬁ",
        13: "a\r\nb\x0bc\x0cd", 14: prose.upper() + "!!",
    }
    rows = [Row(doc_id=k, text=v, lang=None if k % 5 == 0 else "en", source=None if k % 4 == 0 else f"s{k % 3}", n_chars=k,
                kept="old", size="old", ids="old", n_tokens="old", total="old", class_id="old", bands="old", score="old")
            for k, v in texts.items()]
    rows.append(rows[3])  # a whole row twice
    rows.append(Row(**{**rows[3].asDict(), "doc_id": None}))
    return spark.createDataFrame(rows)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, int(k % 3 != 0), int(k % 5 == 0)) for k in range(15)] + [(None, 1, 0), (4, None, None), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
