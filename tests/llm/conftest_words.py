"""Prose for fixtures."""

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("" if rng.random() < 0.8 else rng.choice(WORDS)) for _ in range(n))
