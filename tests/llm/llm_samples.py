"""Texts that the tests of this folder share."""

WORDS = "casa perro gato luna sol mar río monte piedra árbol the of and house river stone der und das Haus Stein le la maison pierre".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", "s"]) for _ in range(n))
