"""Fixed word lists.

These values are public and must be equal to the published lists for results to
be right: the English stop words (entries without an apostrophe, the only ones
that can still occur after punctuation is stripped) and the degree and negation
words of the polarity rule set (Hutto & Gilbert 2014; apostrophes removed).
"""

STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now d ll m o re ve y ain aren
couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn
weren won wouldn
""".split()

INTENSIFIERS = """
absolutely amazingly awfully completely considerably decidedly deeply effing
enormously entirely especially exceptionally extremely fabulously flipping flippin
fricking frickin frigging friggin fully fucking greatly hella highly hugely
incredibly intensely majorly more most particularly purely quite really remarkably
so substantially thoroughly totally tremendously uber unbelievably unusually
utterly very
""".split()

DAMPENERS = """
almost barely hardly kinda kindof less little marginally occasionally partly
scarcely slightly somewhat sorta sortof
""".split()

NEGATORS = """
aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt
mightnt mustnt neednt neither never none nope nor not nothing nowhere oughtnt shant
shouldnt uhuh wasnt werent without wont wouldnt rarely seldom despite
""".split()

DEGREE = 0.293
NEGATION = -0.74

# A small word table (token, valence) for tests and first steps; a real one is
# passed in as a table.
SEED_VALENCES = {
    "beat": 1.1, "gain": 2.4, "gains": 1.4, "good": 1.9, "great": 3.1,
    "growth": 1.6, "improve": 1.9, "profit": 1.9, "profits": 1.9, "rally": 1.2,
    "rise": 1.1, "strong": 2.3, "success": 2.7, "surge": 1.3, "win": 2.8,
    "bad": -2.5, "crisis": -3.1, "debt": -1.5, "decline": -1.4, "drop": -1.1,
    "fail": -2.5, "fall": -1.1, "fear": -2.2, "fraud": -2.8, "loss": -1.3,
    "losses": -1.7, "lawsuit": -0.9, "poor": -2.1, "risk": -1.1, "weak": -1.9,
    "worthless": -1.9,
}
