"""Words that carry no topic. Forms with an apostrophe never match a token and are left out."""

_BY_LENGTH = {
    1: "a i",
    2: "am an as at be by do he if in is it me my no of on or so to up we",
    3: "all and any are but did few for get got had has her him his how inc its llc ltd not off our out own she the too was who why with you",
    4: "also been both corp does down each from have here hers into more most once only ours over same some such than that them then they this very were what when will your",
    5: "about above after again being below could doing these their there those until where which while whom would yours under other ought",
    6: "before cannot during having herein hereof hereby itself myself should theirs",
    7: "against because between company further herself himself nor therein thereof through",
    8: "pursuant yourself",
    9: "ourselves",
    10: "themselves yourselves",
}
STOPWORDS = frozenset(w for words in _BY_LENGTH.values() for w in words.split())
