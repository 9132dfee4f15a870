"""Fixed word lists and character sets."""

# The English stop-words Spark itself ships.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll "
    "we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've "
    "they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't "
    "mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's "
    "would"
).split()

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Part-of-speech tags that carry little meaning for a pair score.
UNIMPORTANT_TAGS = (
    "CC", "DT", "EX", "FW", "IN", "JJR", "JJS", "LS", "PDT", "POS", "RB", "RBR", "RBS", "RP", "S", "SBAR", "SBARQ",
    "SYM", "TO", ".", "))", "((",
)

# A small sample valence lexicon (word: mean rating, -4 to 4).
# Callers with a full lexicon pass their own table.
SAMPLE_VALENCE = {
    "amazing": 2.8, "awesome": 3.1, "awful": -2.0, "bad": -2.5, "beautiful": 2.9, "best": 3.2, "boring": -1.3,
    "brilliant": 2.8, "cool": 1.3, "disappointing": -2.2, "dull": -1.7, "enjoy": 2.2, "excellent": 2.7,
    "excited": 1.4, "fail": -2.5, "fantastic": 2.6, "fun": 2.3, "funny": 1.9, "glad": 2.0, "good": 1.9,
    "great": 3.1, "happy": 2.7, "hate": -2.7, "horrible": -2.5, "interesting": 1.7, "like": 1.5, "love": 3.2,
    "lovely": 2.8, "nice": 1.8, "perfect": 2.7, "poor": -2.1, "sad": -2.1, "scary": -2.2, "stupid": -2.4,
    "super": 2.9, "terrible": -2.1, "ugly": -2.3, "waste": -1.8, "win": 2.8, "wonderful": 2.7, "worst": -3.1,
    "wrong": -2.1,
}

# Words before a valence word that turn it round, and words that
# strengthen or weaken it (published rule-based sentiment, 2014).
NEGATORS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent",
    "isnt", "mightnt", "mustnt", "neither", "neednt", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent", "without", "wont", "wouldnt", "rarely", "seldom",
    "despite",
)
STRENGTHENERS = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "enormously",
    "entirely", "especially", "exceptionally", "extremely", "fabulously", "fully", "greatly", "highly", "hugely",
    "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely", "quite", "really", "remarkably",
    "so", "substantially", "thoroughly", "totally", "tremendously", "uber", "unbelievably", "unusually", "utterly",
    "very",
)
WEAKENERS = ("almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly",
             "scarcely", "slightly", "somewhat", "sorta")
