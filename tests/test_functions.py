import time

import pytest

from letterloom.functions import charset
from letterloom.functions.addresses import parse_addresses
from letterloom.functions.charset import codec_of, decode_charset
from letterloom.functions.dates import iso_date
from letterloom.functions.html import decode_html_entities, escape_html, html_to_text, text_to_html
from letterloom.functions.transfer import base64_body, decode_base64_lenient, decode_qp, quoted_printable_body
from letterloom.functions.words import decode_percent, decode_words, is_encoded_words_only, parse_structured, strip_comments


@pytest.mark.parametrize(("label", "codec"), [("UTF-8", "utf-8"), ("latin1", "cp1252"), ("x-sjis", "cp932"), ("cp936", "gb18030"), ("ISO-8859-8-I", "iso8859-8"), ("cp437", "cp1252"), ("nonsense", "cp1252"), (None, "utf-8"), ("windows-1251", "cp1251"), ("x-euc_jp", "euc_jp")])
def test_charset_labels(label, codec):
    assert codec_of(label) == codec


def test_charset_never_fails():
    assert decode_charset(b"\x81\x80", "windows-1252") == "\x81€"
    assert decode_charset(b"\xef\xbb\xbfa\xff", "utf-8") == "a�"
    assert decode_charset(None) == ""


def test_encoded_words():
    assert decode_words("=?UTF-8?Q?a?= =?UTF-8?Q?b_c?= x") == "ab c x"
    assert decode_words("=?UTF-8?B?w7U=?= =?UTF-8?Q?=C3?= =?UTF-8?Q?=B5?=") == "õõ"
    assert decode_words("=?iso-8859-1*en?q?=e1?=") == "á"
    assert decode_words(None) == "" and decode_words("plain =?x") == "plain =?x"
    assert is_encoded_words_only("=?a?q?b?= =?a?q?c?=") and not is_encoded_words_only("x =?a?q?b?=")


def test_structured_headers():
    value, params = parse_structured('Multipart/Mixed; boundary="a\\"b"; boundary=c; flag; Name = x y (no) ; q="in" junk')
    assert value == "multipart/mixed"
    assert params == {"boundary": 'a"b', "flag": "", "name": "x y", "q": "in"}
    assert parse_structured("a/b; filename*1=c; filename*0*=utf-8''%C3%A9%20")[1] == {"filename": "é c"}
    assert parse_structured("a/b; filename*0=a%2F")[1] == {"filename": "a%2F"}
    assert strip_comments("a (b (c) d) e") == "a  e"
    assert strip_comments("x=Invoice(1).pdf") == "x=Invoice(1).pdf"
    assert strip_comments("x (open; boundary=b") == "x (open; boundary=b"
    assert decode_percent("a+%zz%41", None) == "a+%zzA"


def test_transfer_encodings():
    assert decode_base64_lenient("QUJDR") == b"ABC"
    assert base64_body([b"aGVsbG8=", b"d29y", b"bGQ="]) == b"helloworld"
    assert quoted_printable_body([b"a=3Db=", b"c=zz=4"]) == b"a=bc=zz=4\n"
    assert decode_qp("caf=C3=A9") == b"caf\xc3\xa9"


def test_addresses():
    assert parse_addresses('"Doe, J" <j@x.y>, k@x.y') == [{"name": "Doe, J", "address": "j@x.y", "group": None}, {"name": "", "address": "k@x.y", "group": None}]
    group = parse_addresses("team: a@b.c, Bob <b@c.d>;")
    assert group[0]["name"] == "team" and [m["address"] for m in group[0]["group"]] == ["a@b.c", "b@c.d"]
    assert [m["address"] for m in parse_addresses("team: a@b.c, Bob <b@c.d>;", flatten=True)] == ["a@b.c", "b@c.d"]
    # an address inside quotes is never taken
    assert parse_addresses('"a@b.c"')[0]["address"] in ("", "a@b.c")
    assert parse_addresses('"evil@x.y" <real@z.w>')[0]["address"] == "real@z.w"
    assert parse_addresses("=?utf-8?q?a=40b.c?=")[0]["address"] == ""
    assert parse_addresses(None) == [] and parse_addresses("") == []


def test_html():
    assert decode_html_entities("&amp;&copy &#x41;&#65&#xD800;&ampfoo;") == "&© A&#65�&ampfoo;"
    assert escape_html(" <a&'> ") == "&#x3C;a&#x26;&#x27;&#x3E;"
    assert text_to_html("a\nb") == "<div>a<br />b</div>"
    assert html_to_text("<html><body><p>a <b>b</b></p><a href='u'>l</a><br>c</body></html>").split() == ["a", "b", "(u)", "l", "c"]


@pytest.mark.parametrize(("text", "out"), [("Tue, 8 Mar 2005 23:40:36 +0200", "2005-03-08T21:40:36.000Z"), ("2020-01-02T03:04:05.678+01:00", "2020-01-02T02:04:05.678Z"), ("no date", "no date"), ("", "")])
def test_dates(text, out):
    assert iso_date(text) == out


def test_address_search_is_linear():
    start = time.time()
    parse_addresses("x" + " " * 50_000 + "y" * 50_000)
    assert time.time() - start < 5


def test_numbers_that_are_too_long():
    from letterloom.functions.html import decode_html_entities
    from letterloom.functions.words import continued

    assert decode_html_entities("&#" + "9" * 5000 + ";&#" + "0" * 5000 + "65;&#x" + "f" * 5000 + ";") == "\ufffdA\ufffd"
    assert continued({"n*" + "9" * 5000: "b", "n*0": "a"}) == {"n": "ab"}


def test_many_comments_without_an_end():
    import time

    from letterloom.functions.html import html_to_text

    start = time.time()
    html_to_text("<!-- a -->" + "<!--" * 50_000 + "<script>" * 50_000)
    assert time.time() - start < 5


def test_every_label_decodes():
    for label, codec in charset._KNOWN.items():
        text = "Az é Ж 中 🙂" if codec.startswith("utf") else "".join(c for c in "Az é ž Ж ģ א β ع ก 中 あ 한" if c.encode(codec, "ignore"))
        assert charset.decode_charset(text.encode(codec), f" {label.upper()} ") == text


def test_koi8_u():
    assert charset.decode_charset(b"\xae\xbe\xc1", "koi8-u") == "\u045e\u040e\u0430"


def test_fold_lines_keeps_words_and_own_lines():
    from letterloom.functions.render import fold_lines

    text = "word " * 40 + "x" * 100 + " end\nown line\r\n" + "last " * 3
    for after in (False, True):
        out = fold_lines(text, 30, after)
        assert out.replace("\r\n", "").replace("\n", "") == text.replace("\r\n", "").replace("\n", "")
        assert all(len(x) <= 30 or " " not in x.strip() for x in out.splitlines())
    assert fold_lines("ab cd ef", 5) == "ab\r\n cd\r\n ef" and fold_lines("ab cd ef", 6, True) == "ab cd \r\nef"
