"""Stop-word lists.

Fixed values: the English Snowball stop-word list (175 entries, public
Snowball project list as distributed for R's ``stopwords`` package,
source = "snowball").  The test-set document-term table of the original
workflow always uses this list.
"""

SNOWBALL_EN = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what",
    "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "would", "should", "could", "ought", "i'm", "you're", "he's",
    "she's", "it's", "we're", "they're", "i've", "you've", "we've", "they've", "i'd", "you'd",
    "he'd", "she'd", "we'd", "they'd", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "isn't", "aren't", "wasn't", "weren't", "hasn't", "haven't", "hadn't", "doesn't", "don't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "can't", "cannot", "couldn't", "mustn't", "let's", "that's",
    "who's", "what's", "here's", "there's", "when's", "where's", "why's", "how's", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
    "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "will",
)

# Extra words the workflow's own helper appended to the Snowball
# list (web fragments and time words), in the order written there.
EXTRA_WORKFLOW = (
    "it", "me", "and", "in", "the", "https", "www", "com", "to", "a", "my", "but", "for",
    "have", "is", "of", "you", "don", "not", "he", "last", "two", "weeks", "years", "ago", "day",
)


def get_stopwords(extra: bool = True) -> list[str]:
    """Snowball English plus (optionally) the workflow's extra words, de-duplicated."""
    words = list(SNOWBALL_EN) + (list(EXTRA_WORKFLOW) if extra else [])
    return list(dict.fromkeys(words))


def split_ngram_stopwords(words, sep: str = "_") -> tuple[list[str], list[str]]:
    """Unigram stop words filter tokens before n-grams are built; stop words
    that contain the n-gram separator (``https_www``) filter built n-grams."""
    uni = [w for w in words if sep not in w]
    multi = [w for w in words if sep in w]
    return uni, multi
