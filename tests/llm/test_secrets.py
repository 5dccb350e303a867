import base64
import json
import re

from tests.llm.data import SF, edge_docs, empty_docs
from voxelyard.llm import secrets as s


def brute(text):
    text = text or ""
    out = []
    pattern = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for k, p, size in (("assign", pattern, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 18), ("hex", re.compile("[0-9a-f]+"), 16)):
        out += [(m.start(), k, m.end()) for m in p.finditer(text) if len(m[2] if k == "assign" else m[0]) >= size]
    return out


def test_base_spans(spark):
    texts = [r.text for f in (spark.read.parquet(f"{SF}/documents.parquet"), edge_docs(spark)) for r in f.select("text").collect()]
    texts += ["token: secret=abcdefghijkl", "API_KEY='0123456789abcdef' AKIA" + "A" * 14, "ſecret=abcdefghijklmnop", "toKen=abcdefghijklmnop", "password = short token=longenough_value", "\U0001f600 passwd:\"ABCDEFGHIJKL"]
    order = {"assign": 0, "access": 1, "hex": 2}
    for t in texts:
        want = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(brute(t), key=lambda x: (x[0], order[x[1]])))
        got = s.scan(t)
        assert got[3] == want
        assert all(x in got[4].split(",") for x in got[3].split(",") if x)


def der(*values):
    body = b"".join(values)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return b"\x30" + size + body


def container(public, private):
    field = lambda x: len(x).to_bytes(4, "big") + x
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + b"\0\0\0\1" + field(public) + field(private)


OID = b"\x06\x07\x2a\x86\x48\xce\x3d\x02\x01"


def forms():
    """Private keys in their usual encodings, and what looks like them but is no secret."""
    number = b"\x02\x40" + bytes([1, *range(63)])
    octets = lambda x: b"\x04" + (bytes([len(x)]) if len(x) < 128 else b"\x82" + len(x).to_bytes(2, "big")) + x
    bits = lambda x: b"\x03" + (bytes([len(x) + 1]) if len(x) < 127 else b"\x82" + (len(x) + 1).to_bytes(2, "big")) + b"\0" + x
    rsa = der(b"\x02\x01\x00", *[number] * 8)
    ec = der(b"\x02\x01\x01", octets(bytes(range(32))), b"\xa0\x09" + OID, b"\xa1\x24" + bits(bytes(33)))
    private = [rsa, ec, der(b"\x02\x01\x00", der(OID, b"\x05\x00"), octets(rsa)), der(der(OID, der(octets(bytes(8)))), octets(bytes(range(64)))), container(bytes(51), bytes(120))]
    spki = der(der(OID, b"\x05\x00"), bits(der(number, b"\x02\x03\x01\x00\x01")))
    certificate = der(der(b"\xa0\x03\x02\x01\x02", number, der(OID), spki), der(OID), bits(bytes(64)))
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-rsa", b"\x01\x00\x01", bytes(range(1, 130))))
    garbage = der(b"\x02\x01\x00", b"\x30\x20" + b"\x30\x7f" + bytes(30), octets(bytes(40)))
    other = [spki, certificate, ssh, der(number, b"\x02\x03\x01\x00\x01"), der(b"\x02\x20" + bytes(32), b"\x02\x20" + bytes(32)), garbage, rsa[:-1], rsa + b"\0", container(bytes(51), bytes(120))[:-2]]
    return private, other


def test_private_keys_are_found_where_they_stand_and_nothing_else():
    import random

    rng = random.Random(6)
    private, other = forms()
    write = [lambda x: base64.b64encode(x).decode(), lambda x: x.hex(), lambda x: base64.b64encode(x).decode().rstrip("="), lambda x: "\n".join(re.findall(".{1,64}", base64.b64encode(x).decode()))]
    for _ in range(300):
        text, want = "Some words first: ", set()
        for _ in range(rng.randrange(1, 6)):
            good = rng.random() < 0.5
            spelled = rng.choice(write)(rng.choice(private if good else other))
            if good:
                want.add(f"key:{len(text)}:{len(text) + len(spelled)}")
            text += spelled + rng.choice([" and more. ", "\n\nA new line, ", "; "])
        assert {x for x in s.scan(text)[4].split(",") if x.startswith("key")} == want


def test_structures():
    integer = b"\x02\x20" + bytes(range(1, 33))
    key = der(b"\x02\x01\x00", integer, integer, integer)
    assert s.is_der_key(key) and not s.is_der_key(key[:-1]) and not s.is_der_key(key + b"x")
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(32)))
    box = container(ssh, bytes(64))
    assert s.is_ssh_key(box) and not s.is_ssh_key(box[:-1]) and not s.is_ssh_key(ssh)
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b'{"sub":1}', bytes(32)))
    fake = token.replace(token.split(".")[0], base64.urlsafe_b64encode(b'{"a":"b","c":1}').decode().rstrip("="))
    encoded = base64.b64encode(key).decode()
    kinds = lambda t: [x.split(":")[0] for x in s.scan(t)[4].split(",") if x]
    assert kinds(f"see {token} there") == ["token"] and kinds(f"see {fake} there") == []
    assert kinds(f"see {encoded} there") == ["key"] and kinds("see " + encoded[::-1] + " there") == []
    assert "key" in kinds("see " + key.hex() + " there")
    unsigned = ".".join([base64.urlsafe_b64encode(b'{"alg":"none"}').decode().rstrip("="), *token.split(".")[1:]])
    bare = ".".join([token.split(".")[0], "notjson_notjson", token.split(".")[2]])
    assert kinds(f"{unsigned} {bare} {token.rsplit('.', 1)[0]}.AAAA") == []
    armor = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(encoded[i : i + 64] for i in range(0, len(encoded), 64)) + "\n-----END RSA PRIVATE KEY-----"
    assert s.scan(f"a\n{armor}\nb")[4] == f"key:2:{2 + len(armor)}"
    assert kinds("a" * 500_000) == ["hex"]


def test_table(spark):
    docs = edge_docs(spark)
    assert s.scan_secrets(docs).count() == docs.count()
    assert s.scan_secrets(empty_docs(spark)).count() == 0


def test_unpadded_keys_between_lines_of_prose():
    integer = b"\x02\x20" + bytes(range(1, 33))
    for extra in range(1, 7):
        key = der(b"\x02\x01\x00", *[integer] * 4, b"\x04" + bytes([extra]) + bytes(extra))
        for raw in (key, container(bytes(40), bytes(60 + extra))):
            one = base64.b64encode(raw).decode().rstrip("=")
            for body in (one, "\n".join(one[i : i + 64] for i in range(0, len(one), 64)), "\r\n".join(one[i : i + 64] for i in range(0, len(one), 64))):
                for after in ("\nThis is prose.", "\r\nnext", "\nab", "\nabc\ndef word", "\nhello world"):
                    assert f"key:3:{3 + len(body)}" in s.scan(f"x: {body}{after}")[4].split(",")
    one = base64.b64encode(der(b"\x02\x01\x00", *[integer] * 3, b"\x04\x01\x00")).decode().rstrip("=")
    digest = "Zz" * 30
    assert s.scan(f"{digest}\n{one}\n{one}\nend")[4] == f"key:61:{61 + len(one)},key:{62 + len(one)}:{62 + 2 * len(one)}"
