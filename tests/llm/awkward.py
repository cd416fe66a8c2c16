"""Rows that every operator must bear."""

AWKWARD = [(None, "no id here but some text"), (900, None), (901, ""), (902, " \t\n"), (903, "é" * 300_000),
           (904, "word " * 60_000), (905, "same text twice"), (905, "same text twice"), (906, "!?&")]
