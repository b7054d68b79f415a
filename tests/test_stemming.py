import pytest

from ledgerline.functions.stemming import ENGLISH_STOP_WORDS, stem, stems

# the published sample of the algorithm's vocabulary: words and their stems
SAMPLE = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir
conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc
constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock
knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
""".split()  # noqa: SIM905


@pytest.mark.parametrize("word, want", list(zip(SAMPLE[::2], SAMPLE[1::2])))
def test_published_vocabulary(word, want):
    assert stem(word) == want


@pytest.mark.parametrize("word, want", [
    ("skies", "sky"), ("dying", "die"), ("news", "news"), ("proceeding", "proceed"), ("exceeds", "exceed"), ("inning", "inning"), ("generate", "generat"), ("general", "general"),
    ("communities", "communiti"), ("arsenal", "arsenal"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("kiwis", "kiwi"), ("ties", "tie"), ("cries", "cri"), ("hoping", "hope"),
    ("hopping", "hop"), ("hoped", "hope"), ("luxuriated", "luxuri"), ("say", "say"), ("by", "by"), ("cry", "cri"), ("enjoy", "enjoy"), ("youth", "youth"), ("boyish", "boyish"),
    ("relational", "relat"), ("filings", "file"), ("risks", "risk"), ("revenues", "revenu"), ("liabilities", "liabil"), ("10k", "10k"), ("agreed", "agre"), ("feed", "feed"),
    ("bed", "bed"), ("shed", "shed"), ("shred", "shred"), ("rate", "rate"), ("adoption", "adopt"), ("analogies", "analog"), ("quickly", "quick"), ("company's", "compani"),
    ("controlling", "control"), ("roll", "roll"), ("hopefulness", "hope"), ("", ""), ("a", "a"), ("été", "été"),
])
def test_rules(word, want):
    assert stem(word) == want


def test_stop_words():
    assert len(ENGLISH_STOP_WORDS) == len(set(ENGLISH_STOP_WORDS)) == 127


def test_column(spark):
    row = spark.createDataFrame(
        [(["risks", "filings", None],), (None,), ([],)], "w array<string>"
    ).select(stems("w")).collect()
    assert [r[0] for r in row] == [["risk", "file", None], None, []]
