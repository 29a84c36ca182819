import pytest

from tertulia.functions import text as T
from tertulia.operators import tokens


@pytest.mark.parametrize("function, cases", [
    (T.remove_accents, [("canción niño Ñu", "cancion niño Nu"), ("éüçà", "euca"), ("á", "a"), ("ά й", "α и")]),
    (T.strip_urls, [
        ("ve https://a.b/c ya", "ve  ya"), ("www.x.y z", " z"), ("sitio.com.mx/x fin.de y/o", " fin.de y/o"),
        ("¡Foo.COM!", "¡"), ("a.b/c", ""), ("abchttps://x y", "abc y"), ("foo.company", "foo.company"),
        (".a/b", ".a/b"), ("..a/b", "")]),
    (T.normalize_text, [("A,b C", "ab c"), ("übeR ça", "ber a"), ("Ñandú 3!", "ñandú 3")]),
    (T.clean_text, [("a_b\tCANCIÓN", "a b cancion"), ("http://x/a_b fin", " b fin")]),
])
def test_functions(on_texts, function, cases):
    assert on_texts(function, [c[0] for c in cases]) == [c[1] for c in cases]


def words(df):
    return [r.words for r in df.orderBy("msg_idx").collect()]


def test_tokens(messages):
    rows = messages(
        ("t", "a", "También QUÉ tal la canción, añadió niño"),
        ("t", "b", "Multimedia omitido"), ("t", "b", None), ("t", "b", "a,b 12 más"))
    # Accented stop words are compared after folding, so they do not match.
    assert words(tokens.tokenize(rows)) == [["tambien", "tal", "cancion", "niño"], [], None, ["ab", "12"]]
    assert words(tokens.tokenize(rows, fold_stopwords=True))[0] == ["tal", "cancion", "niño"]
    assert words(tokens.tokenize(rows, custom=["tal"]))[0] == ["tambien", "cancion", "niño"]
    assert words(tokens.tokenize(rows))[0][1] == "tal"  # no call leaks into the next
    assert words(tokens.tokenize(rows, null_text="nan"))[2] == ["nan"]


def test_token_rows_and_text(messages):
    rows = tokens.tokenize(messages(("t", "a", "nube el dos"), ("t", "b", "tres"), ("t", "a", "cuatro")))
    found = tokens.explode_tokens(rows).orderBy("msg_idx", "pos").collect()
    assert [(r.msg_idx, r.sender, r.pos, r.token) for r in found] == [
        (1, "a", 0, "nube"), (1, "a", 1, "dos"), (2, "b", 0, "tres"), (3, "a", 0, "cuatro")]
    assert [r.clean_text for r in tokens.clean_message_text(rows).orderBy("msg_idx").collect()] == [
        "nube dos", "tres", "cuatro"]
    joined = {(r.sender, r.text_no): r.clean_text for r in tokens.clean_text_by_sender(rows, 2).collect()}
    assert joined == {("a", 0): "nube dos", ("b", 0): "tres", ("a", 1): "cuatro"}


def test_stop_word_table(spark, messages):
    rows = tokens.explode_tokens(tokens.tokenize(messages(("t", "a", "uno dos")), stopwords=[]))
    table = spark.createDataFrame([("dos",)], "token string")
    assert [r.token for r in tokens.filter_stopwords(rows, table).collect()] == ["uno"]


def test_text_column(spark):
    assert tokens.text_column(spark.createDataFrame([("a", "b")], "x string, message string")) == "message"
    first = spark.createDataFrame([("hola mundo", "b")], "x string, y string")
    assert tokens.tokenize(first).first().words == ["mundo"]


def test_top_words(messages):
    rows = tokens.tokenize(messages(("t", "a", "sol sol mar"), ("t", "b", "mar luz luz sol")))
    assert [tuple(r) for r in tokens.top_words(rows, 2).collect()] == [("sol", 3), ("luz", 2)]
    per = tokens.top_words_per_member(rows, 1).orderBy("sender").collect()
    assert [tuple(r) for r in per] == [("a", "sol", 2), ("b", "luz", 2)]
