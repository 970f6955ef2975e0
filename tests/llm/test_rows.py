"""Row-wise parts against plain readings of their contracts: parsers, lexer, codec, encoder, chat text."""

from __future__ import annotations

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from spanledger.llm import chat, codec, minhash, pii, recurrent, secrets, tokens, toxicity
from spanledger.llm import words as W

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"(?a:(?i:(password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def texts(pool, n, size):
    rnd = random.Random(n)
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def plain_pii(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@pytest.mark.parametrize("pool", ["ab@.-+ 01 5", "0123.. 255", "0123456789 -", "+0 (.)-1234567890", "a@b.c@d.e+1 é23.4.5.6.7"])
def test_personal_data_equals_the_patterns(pool):
    for t in [*texts(pool, 4000, 40), "", pool * 5000]:
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == plain_pii(t)


def test_personal_data_added_and_masked():
    t = "see https://user@example.org:8080/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678 x"
    assert [(k, t[a:b]) for k, a, b in pii.spans(t) if k in pii.ADDED] == [
        ("url", "https://user@example.org:8080/a?b=1"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]
    assert pii.masked("mail me@here.org now") == "mail [EMAIL] now" and pii.masked("nothing here") == "nothing here"


def test_ibans_stand_anywhere():
    good = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947", "PL61 1090 1014 0000 0712 1981 2874", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "FR1420041010050500013M02606"]
    for form in ("IBANs: {}.", "no cue {}", "IBAN of the account that we told you about in our letter of last week, please: {}", "IBAN DE00 3704 0044 0532 0130 00, {}", "IBAN: " + "x" * 50 + " {} NEXT WORD", "IBAN{}"):
        for parts in ([g] for g in good):
            t = form.format(", ".join(parts))
            assert [t[a:b] for k, a, b in pii.spans(t) if k == "iban"] == parts
        t = form.format(", ".join(good))
        assert [t[a:b] for k, a, b in pii.spans(t) if k == "iban"] == good
    for t in ("DE88 3704 0044 0532 0130 00", "XDE89370400440532013000", "DE89370400440532013000x", "DE89", "DE89 3704"):
        assert not [s for s in pii.spans(t) if s[0] == "iban"]
    assert pii.masked("IBANs: " + ", ".join(good[:3])) == "IBANs: [IBAN], [IBAN], [IBAN]"


def test_secrets_equal_the_patterns():
    pool = ["token", "secret", "Password", "api_key", "APIKEY", "=", ":", " ", "'", '"', "ab", "12", "abcdef", " " * 200, "AKIA", "ABCD1234EFGH5678",
            "0123456789abcdef", "\n", "é", "x.", "ſecret"]
    for t in [*texts(pool, 8000, 25), "", "a=" * 20000]:
        want = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
        got = [s for s in secrets.spans(t) if s[0] in secrets.BASE]
        assert got == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_constants_reach_sensitive_names():
    t = 'base = "Zx9$kLm2Qw8!pR"\nother = base\ndb_password = other\ncolour: "hello world"\nclient_credential: "aB3xY9zQ1w7K"\n'
    assert [(k, t[a:b]) for k, a, b in secrets.spans(t)] == [("constant", "Zx9$kLm2Qw8!pR"), ("literal", "aB3xY9zQ1w7K")]


@pytest.mark.parametrize("line", ["ssh_key = 'q7x2m9d4k8w1z5t3'", "session_key = 'q7x2m9d4k8w1z5t3'", "auth = 'q7x2m9d4k8w1z5t3'", "pwd = 'hunter2'", "pwd = hunter2",
    "pwd = 'My9fK2x7Qw81'", "pwd = 'theX72mKq901'", "pwd = 'None7xK2m9Qz'", "pwd = 'x7Kq" + "aZ3-" * 2500 + "'", "pwd = x7Kq" + "aZ3-" * 2500])
def test_secrets_of_sensitive_names(line):
    value = line.split(" = ")[1].strip("'")
    assert [(k, line[a:b]) for k, a, b in secrets.spans(line)] == [("literal", value)]


K = "q7x2m9d4k8w1z5t3"


@pytest.mark.parametrize("text, found", [
    (f'api_token: str = "{K}"', [K]), (f'signing_key: Optional[str] = "{K}"', [K]), (f'ssh_key = b"{K}"', [K]), (f'signing_key = rb"{K}"', [K]), (f'config["signing_key"] = "{K}"', [K]), (f"os.environ['SSH_KEY'] = '{K}'", [K]),
    (f'client_secret = """{K}\n{K}"""', [f"{K}\n{K}"]), ('auth = "abc7K2q" + "x9Z4mm1Q"', ["abc7K2q", "x9Z4mm1Q"]), ('signing_key = (\n  "q7x2m9d4"\n  "k8w1z5t3"\n)', ["q7x2m9d4", "k8w1z5t3"]),
    ('passphrase = "correct horse battery staple"', ["correct horse battery staple"]), ('passphrase = "enter your passphrase here"', []), ("signing_key: |\n  q7x2m9d4\n\n  k8w1z5t3\nother: 1", ["q7x2m9d4", "k8w1z5t3"]),
    (f"<sshKey>{K}</sshKey>", [K]), (f'<db passphrase="{K}">x</db>', [K]), ('setenv("DB_PASSWORD", "q7x2m9d4")', ["q7x2m9d4"]), (f'dbPassword := "{K}"', [K]), (f'ssh_key => "{K}"', [K]), (f'connect(auth="{K}")', [K]), (f'"ssh_key": "{K}",', [K]),
    (f'ssh_key = LATER\nLATER = "{K}"', [K]), ('signing_key = PRE + "k8w1z5t3x"\nPRE = "q7x2"', ["k8w1z5t3x", "q7x2"]), ("a = b\nb = a\nssh_key = a", []), (f'x = "first9Z"\nssh_key = x\nx = "{K}"', []), (f"it's so, don't pwd = '{K}'", [K]), ('pwd == "hunter2"', []),
])
def test_secrets_of_real_syntax(text, found):
    assert sorted(text[a:b] for k, a, b in secrets.spans(text) if k in secrets.ADDED) == sorted(found)


def test_secrets_pass_over_placeholders():
    for t in ("pwd = 'my_password'", "pwd = 'changeme'", "pwd = ''", "pwd = None", "pwd = 'xxxxxxxxxx'", "def f(pwd: str):", "pwd = '$HOME_DIR_X'", "colour = 'q7x2m9d4k8w1z5t3'"):
        assert secrets.spans(t) == []


def test_secrets_endings_equal_the_whole_literals():
    for t in texts("abcXY019-._=: pwdkey", 2000, 60):
        starts = list(range(len(t.replace(" ", ""))))
        t = t.replace(" ", "")
        got = secrets._endings(t, starts, len(t))
        assert all(abs(got[s, len(t)] - secrets.keyness(t[s:])) < 1e-9 for s in starts)


def test_secrets_cost_grows_with_the_length():
    for form in ("pwd=", "auth:'", 'key="\\', "salt= ", "<a ", "a = b\nb = a\n", "a = (\n", "k: |\n b\n", "x[y]: "):
        spent = []
        for n in (3_000, 12_000):
            began = time.process_time()
            secrets.spans(form * n)
            spent.append(time.process_time() - began)
        assert spent[1] < 10 * spent[0] + 0.1


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_codec_round_trip(block):
    rng = np.random.default_rng(1)
    streams = [rng.integers(0, 65536, n).astype(np.uint32) for n in (0, 1, 5, 49)] + [np.zeros(300, np.uint32), np.tile(np.arange(7, dtype=np.uint32), 90)]
    if block == 2048:
        streams += [rng.zipf(1.3, 9000).clip(0, 65535).astype(np.uint32), rng.integers(0, 65536, 2049).astype(np.uint32)]
    packed = codec.pack_ids(streams, block)
    assert all(np.array_equal(a, b) for a, b in zip(codec.unpack_ids(packed), streams, strict=True))
    assert codec.unpack_ids([]) == []


def test_codec_notices_damage_and_learns():
    ids = np.tile(np.arange(50, dtype=np.uint32), 200)
    data = codec.pack_ids([ids])[0]
    assert len(data) < len(ids) / 4
    for at in (4, 40, len(data) // 2, len(data) - 200):
        for broken in (data[:-2], data[:at], data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]):
            with pytest.raises(ValueError):
                codec.unpack_ids([broken])
    with pytest.raises(ValueError):
        codec.pack_ids([np.array([65536], np.uint32)])


def test_codec_mixes_all_three_orders():
    """Independent ids cost little more than their entropy; ids that follow from the last one, or from the last two, far less."""
    rng = np.random.default_rng(1)

    def bits(ids):
        data = codec.pack_ids([ids.astype(np.uint32)])
        assert np.array_equal(codec.unpack_ids(data)[0], ids)
        return 8 * len(data[0]) / len(ids)

    skewed = rng.zipf(1.35, 400_000).clip(0, 3000)
    share = np.bincount(skewed)[np.unique(skewed)] / len(skewed)
    assert bits(skewed) < 1.05 * -(share * np.log2(share)).sum()
    after = rng.integers(0, 300, 300)
    chain = [0]
    for fresh, jump in zip(rng.integers(0, 300, 60_000).tolist(), (rng.random(60_000) < 0.1).tolist(), strict=True):
        chain.append(fresh if jump else int(after[chain[-1]]))
    assert bits(np.array(chain)) < 3
    two = [0, 1]
    for fresh, jump in zip(rng.integers(0, 20, 60_000).tolist(), (rng.random(60_000) < 0.1).tolist(), strict=True):
        two.append(fresh if jump else (two[-1] * 7 + two[-2] * 3 + 1) % 20)
    assert bits(np.array(two)) < 2


@pytest.mark.parametrize("lanes, steps", [(3, 5), (64, 32), (2, 1)])
def test_codec_reads_blocks_of_any_lengths_side_by_side(monkeypatch, lanes, steps):
    """Blocks that end among the steps worked out at once, both orders naming one id, streams of one id only."""
    monkeypatch.setattr(codec, "LANES", lanes)
    monkeypatch.setattr(codec, "STEPS", steps)
    rng = np.random.default_rng(4)
    streams = [rng.integers(0, most, n).astype(np.uint32) for n, most in zip(rng.integers(0, 200, 30).tolist(), [1, 2, 3, 9, 65536] * 6, strict=True)]
    streams += [np.full(n, 65535, np.uint32) for n in (1, 4, 5, 6, 97)] + [np.tile(np.array([7, 7, 3], np.uint32), 60)]
    for block in (33, 64):
        assert all(np.array_equal(a, b) for a, b in zip(codec.unpack_ids(codec.pack_ids(streams, block)), streams, strict=True))


def test_letters_up_to_ff_need_one_call_of_the_library(monkeypatch):
    """Pieces whose bytes tell where each ends go to the library as one text, other pieces one by one."""
    enc, given = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json")), []

    class Spy:
        def encode_batch_fast(self, texts, **more):
            given.append(len(texts))
            return whole.encode_batch_fast(texts, **more)

    whole, enc.tokenizer = enc.tokenizer, Spy()
    for text, calls in (("Größe où ÉTÉ niño*** ß×÷ µ¼ a-b", [1]), ("größe Straße Ł œuvre İ", [1, 3])):
        buf = np.frombuffer(text.encode(), np.uint8)
        assert enc.encode(buf, np.array([0, len(buf)]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids
        assert given == calls
        given.clear()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    enc = tokens.Encoder(tokens.vocabulary(name))
    pool = ["hello", "World", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "é", "ß", "<|endoftext|>", "<|", "12", " ", "\r\n", "’", "…", "e", "́", "!?", "İ", "中文", "😀", "\x00", "\x1c", " "]
    many = [*texts(pool, 5000, 30), "", "x" * 5000]
    got = []
    for _, buf, offs in W.pieces(pa.RecordBatch.from_arrays([pa.array(many)], ["text"]), limit=20000):
        ids, first = enc.encode(buf, offs)
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [e.ids for e in enc.tokenizer.encode_batch(many, add_special_tokens=False)]


def test_chat_text_is_reversible():
    pool = ["\\", "#", "###", "### ", "</turn>", "</turn>\n", "<", "a", ":", ": ", "\n", "é", " "]
    for role, text in zip(texts(pool, 3000, 6), reversed(texts(pool, 3000, 12)), strict=True):
        form = chat.written(role, text) + chat.written("b", "c")
        assert chat.parse(form) == [(role, text), ("b", "c")]
        assert chat.unescape(form[len(chat.head(role)) : len(chat.written(role, text)) - len(chat.CLOSE)]) == text


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.75, 0.9):
        both = rng.integers(0, 2**64, 4000, dtype=np.uint64)
        k = int(4000 * (1 - share) / 2)
        a, b = np.sort(both[: 4000 - k]), np.sort(both[k:])
        equal = np.array([(minhash.registers(a) == minhash.registers(b)).sum()])
        assert abs(minhash.estimate(equal, np.array([len(a)]), np.array([len(b)]))[0] - share) < 0.12
    assert len(minhash.registers(np.zeros(0, np.uint64))) == 0 and len(minhash.registers(np.array([5], np.uint64))) == minhash.BUCKETS


def test_network_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    p = recurrent.fresh(np.arange(5, dtype=np.uint64))
    p = {k: v if k == "vocabulary" else v.astype(np.float64) for k, v in p.items()}
    words, begin, end = rng.integers(0, 6, (4, 3)), rng.integers(0, 9, (4, 3)), rng.integers(0, 9, (4, 3))
    mask, label = np.arange(4)[:, None] < np.array([4, 2, 3]), np.array([1.0, 0, 1])

    def loss():
        x = np.concatenate([p["word"][words], p["char"][begin] + p["char"][end]], 2)
        z, _ = recurrent.forward(p, {s: x @ p["x" + s] + p["c" + s] for s in "fb"}, mask)
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    g = recurrent._gradient(p, words, begin, end, mask, label)
    for name in ("o", "u", "v", "hf", "hb", "xf", "cb", "word", "char"):
        flat = p[name].reshape(-1)
        i = int(np.abs(g[name].reshape(-1)).argmax())
        was, step = flat[i], 1e-3
        flat[i] = was + step
        up = loss()
        flat[i] = was - step
        down = loss()
        flat[i] = was
        assert abs((up - down) / (2 * step) - g[name].reshape(-1)[i]) < 2e-3, name


@pytest.mark.parametrize("shape", ["internationali{}ation", "a" * 40 + "{}" + "b" * 40, "这是一个很长的{}句子没有空格", "one_two_{}_three", "one/two-{}-three", "one two {} three", "<p class=a>{}</p><hr>", "มีคำ{}ยาวมากๆ"])
def test_network_reads_every_character(shape):
    p = recurrent.fresh(np.arange(5, dtype=np.uint64))
    buf, offs = W.raw(pa.array([shape.format(c) for c in "zk坏好"]))
    logits = recurrent.evidence(p, buf, offs)[2]
    assert len(set(logits.tolist())) == 4
    low, starts, ends = recurrent.inputs(buf, offs)[4]
    inside = np.zeros(len(low) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    assert b"".join(bytes([c]) for c, n in zip(low, np.cumsum(inside), strict=False) if n) == re.sub("[  ]", "", buf.tobytes().decode()).lower().encode()


def test_network_gradient_of_bytes_is_the_slope():
    rng = np.random.default_rng(0)
    p = {k: v if k == "vocabulary" else v.astype(np.float64) for k, v in recurrent.fresh(np.arange(5, dtype=np.uint64)).items()}
    buf, offs = W.raw(pa.array(["some words to be read by it and 词语 too"]))
    words, begin, end, first, text = recurrent.inputs(buf, offs)
    spot = rng.integers(0, first[-1], (4, 3))
    word, mask, label = np.zeros((4, 3), np.int64), np.arange(4)[:, None] < np.array([4, 2, 3]), np.array([1.0, 0, 1])
    found = recurrent.grams(text, spot.ravel())

    def loss():
        body = recurrent.bodies(p["gram"], text, 0, int(first[-1])).astype(float)[spot]
        x = np.concatenate([p["word"][word], p["char"][begin[spot]] + p["char"][end[spot]] + body], 2)
        z, _ = recurrent.forward(p, {s: x @ p["x" + s] + p["c" + s] for s in "fb"}, mask)
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    g = recurrent._gradient(p, word, begin[spot], end[spot], mask, label, found)["gram"].reshape(-1)
    flat, i = p["gram"].reshape(-1), int(np.abs(g).argmax())
    was, slope = flat[i], []
    for step in (1e-2, -1e-2):
        flat[i] = was + step
        slope.append(loss() / 2e-2)
    assert abs(g[i]) > 1e-5 and abs(slope[0] - slope[1] - g[i]) < 1e-2 * abs(g[i]) + 1e-5


@pytest.mark.parametrize("find, form", [(pii.spans, "1."), (pii.spans, "account "), (pii.spans, "1.1 "), (secrets.spans, " ")])
def test_cost_grows_with_the_length_of_one_text(find, form):
    def seconds(n):
        text = "password" + form * (n // len(form)) + "= 1"
        begin = time.process_time()
        find(text)
        return time.process_time() - begin

    small, large = min(seconds(200_000) for _ in range(3)), min(seconds(400_000) for _ in range(3))
    assert large < 2.5 * small + 0.05


def test_long_turns_are_parsed_in_bounded_memory():
    text = "x < y and so on " * 1_250_000
    window = chat.written("user", text)
    tracemalloc.start()
    assert chat.parse(window) == [("user", text)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000


@pytest.mark.parametrize("text, form", [
    ("account " + "1" * 39, "1" * 39), ("account: 12345678 - 10 items", "12345678"), ("Account 12345678 ON 12 MAY", "12345678"), ("ACCOUNTS 12345678", None),
    ("Konto: 12345678", "12345678"), ("account no. 1234 5678 9012 and", "1234 5678 9012"), ("cuenta ES-1234-5678", "ES-1234-5678"), ("compte 12345678", "12345678"), ("account 12345678abc", None), ("account 12345", None),
])
def test_account_boundaries(text, form):
    assert [text[a:b] for k, a, b in pii.spans(text) if k == "account"] == ([form] if form else [])


def test_an_encoder_keeps_a_bounded_number_of_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 300)
    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    enc, rng, most = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json")), random.Random(2), 0
    for _ in range(30):
        text = " ".join("%x" % rng.randrange(10**6) for _ in range(90)) + " é 中文"
        buf = np.frombuffer(text.encode(), np.uint8)
        assert enc.encode(buf, np.array([0, len(buf)]))[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
        most = max(most, enc.known)
    assert 300 < most < 400 and len(enc.ids) < 4000


def test_training_reads_a_sample_in_pieces(monkeypatch):
    """Word counts and the windows to train on are the same whatever the size of the pieces."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["good", "plain", "bad" if i % 3 == 0 else "fine", "w%d" % rng.randrange(300)]) for _ in range(rng.randrange(0, 90))) for i in range(300)]
    toxic, made = np.array([int(i % 3 == 0) for i in range(300)]), []
    for size in (1 << 20, 5000):
        monkeypatch.setattr(toxicity, "PIECE_BYTES", size)
        pieces = toxicity._pieces(pa.array(texts))
        counts = toxicity._word_counts(pieces, toxic)
        signal = np.random.Generator(np.random.PCG64(1)).random(len(counts[0]) + 1)
        word, begin, end, size, label, (low, starts, ends), spot = toxicity._windows_to_train(recurrent.fresh(counts[0]), pieces, toxic, signal, np.random.Generator(np.random.PCG64(5)))
        live = np.arange(recurrent.LENGTH) < size[:, None]
        said = [low[a:b].tobytes() for a, b in zip(starts[spot[live]].tolist(), ends[spot[live]].tolist(), strict=True)]
        made.append((*counts, word[live], begin[live], end[live], size, label, said))
    assert all(np.array_equal(a, b) for a, b in zip(*made, strict=True))
    plain = {w for t in texts for w in t.split()}
    assert len(made[0][0]) == len(plain) and made[0][1].sum() == sum(len(set(t.split())) for t in texts)
