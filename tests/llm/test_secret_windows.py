"""Windows inside candidates: what suppresses them and which limit judges them."""

import random
import string

from tidemark.llm import secret_scan


def reported(text):
    return [text[a:b] for a, b, k in secret_scan.Scanner().scan(text)[1] if k == 3]


def test_keys_in_paths_and_beside_placeholders():
    key = "q8ZrT1vYw3KdP0sLx7HnJ5Gb"
    assert any(key in x for x in reported(f"https://hooks.slack.com/services/T02AB4CD9/B07XK2LMN/{key}"))
    long = "kQ9zX2mV7tB4nL8wRcY1uE5hGd3jPs6aFo0iTyWe"
    assert any(long in x for x in reported(f"GET /api/v1/{long}"))
    assert reported(f"{long}xxxx{long}") == [long, long] and reported(f"{long[:18]}xxxx{long[:18]}") == []
    for path in ("src/main/java/org/ApplicationContextFactory2", "/usr/lib/x86_64-linux-gnu/security/modules_v2",
                 "docs/api/getting-started/Configuration_Guide-2024"):
        assert reported(path) == []
    rng, chars = random.Random(5), string.ascii_letters + string.digits + "+/"
    keys = ["".join(rng.choices(chars, k=40)) for _ in range(20000)]
    scanner = secret_scan.Scanner()
    paths = [k for k in keys if scanner.path.fullmatch(k)]
    assert len(paths) > 100 and sum(bool(reported(k)) for k in paths) > 0.95 * len(paths)


def test_glued_and_short_keys_are_judged_by_their_own_class():
    rng = random.Random(7)
    for n in (32, 40, 64):
        for glue in ("sig=", "key-", "a/b_"):
            keys = ["".join(rng.choices("0123456789ABCDEF", k=n)) for _ in range(300)]
            alone = sum(bool(reported(k)) for k in keys)
            assert sum(bool(reported(glue + k)) for k in keys) >= alone > 270
    for n in (16, 17, 18, 19):
        keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) for _ in range(300)]
        assert sum(reported(f"see {k}.") == [k] for k in keys) > 200


def test_long_texts_and_allow_rules_with_groups_of_their_own():
    import time

    rng = random.Random(9)
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    keys = [key(32) for _ in range(20_000)]
    text = " ".join(f"x {k} token = {k}" for k in keys)
    began = time.time()
    base, every = secret_scan.Scanner().scan(text)
    assert time.time() - began < 60 and sum(k == 0 for _, _, k in base) == len(keys)
    # Beside each base match stands the bare key; what a base match covers is not added again.
    bare = [a for a, _, k in every if k == 3]
    assert 0.9 * len(keys) < len(bare) <= 2 * len(keys) and not any(x <= a < y for a in bare[:50] for x, y, _ in base)
    policy = secret_scan.EntropyPolicy(allow=(r"(.)(.).*\2\1", r"(ab)+\1.*"))
    scanner = secret_scan.Scanner(policy)
    assert scanner.allowed("xy12yx") and scanner.allowed("ababab9") and not scanner.allowed("xy12xy")
