from glyphloom.functions import ucd
from glyphloom.functions.uca import collation_key, sort_key

KEYS = """@version 0
0061 ; [.2000.0020.0002] # a
0041 ; [.2000.0020.0008] # A
0062 ; [.2001.0020.0002] # b
0301 ; [.0000.0024.0002] # acute
0063 0068 ; [.2003.0020.0002] # ch
0063 ; [.2002.0020.0002] # c
0068 ; [.2009.0020.0002] # h
002D ; [*0300.0020.0002] # -
"""


def test_order(spark, tmp_path):
    (tmp_path / "allkeys.txt").write_text(KEYS)
    ucd.use_data_dir(str(tmp_path))
    try:
        words = ["b", "a", "A", "á", "ab", "a-b", "ch", "cb", "一", ""]
        d = spark.createDataFrame([(w,) for w in words], "w string")
        got = [r["w"] for r in d.orderBy(collation_key("w")).collect()]
    finally:
        ucd.use_data_dir(None)
    assert got == ["a", "A", "á", "a-b", "ab", "b", "cb", "ch", "一", ""]
    path = str(tmp_path / "allkeys.txt")
    assert sort_key("a-b", "blanked", path) == sort_key("ab", "blanked", path) and sort_key("a-b", "non-ignorable", path) < sort_key("aa", "non-ignorable", path)
    assert sort_key("一") < sort_key("㐀") < sort_key("a")
