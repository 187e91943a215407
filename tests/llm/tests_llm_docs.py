import random


def rows():
    r = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(r.choice(letters) for _ in range(5)) for _ in range(3000)]
    line = "this very line is everywhere"
    docs = [(i, " ".join(r.choice(words) for _ in range(120)) + ("\n" + line if i < 20 else ""), "en", f"s{i % 4}", 0) for i in range(60)]
    docs += [(1000, docs[30][1], "en", "s1", 0), (1001, docs[31][1] + " more", "en", "s2", 0), (1002, None, "en", "s1", 0), (1003, "123 456", "en", None, 0), (1004, "", None, None, None)]
    return docs, [line]
