"""Fixed values.

These lists must equal the values the original workflow uses for results to match, so
they are stated here as plain text, in their natural order.
"""

from __future__ import annotations

import string

# ---------------------------------------------------------------------------------------
# FIXED VALUES: banned product names (pharmaceutical brands and generic names, then
# diagnostic products), in the order the original lists give them; duplicates included.
# The filter lower-cases both sides and uses each distinct term once.
BANNED_PHARMA = [
    "roche", "alecensa", "alectinib", "activase", "alteplase", "cotellic",
    "cobimetinib", "hemlibra", "emicizumab", "glucophage", "metformin",
    "xolair", "omalizumab", "esbriet", "pirfenidone", "enspryng",
    "satralizumab", "bactrim", "sulfamethoxazole", "quaifenesin", "trimethoprim",
    "nutropin", "somatropin", "herceptin", "trastuzumab", "zelboraf",
    "vemurafenib", "tecentriq", "atezolizumab", "xofluza", "baloxavir marboxil",
    "madopar", "benserazide", "levodopa", "avastin", "bevacizumab",
    "lexotan", "bromazepam", "rocaltrol", "calcitriol", "xeloda",
    "capecitabine", "dilatrend", "carvedilol", "rocephin",
    "ceftriaxone", "inhibace", "cilazapril", "rivotril",
    "clonazepam", "valium", "diazepam", "pulmozyme",
    "dornase", "fuzeon", "enfuvirtide", "rozlytrek", "entrectinib",
    "tarceva", "erlotinib", "neorecormon", "erythropoietin",
    "anexate", "flumazenil", "cymevene", "ganciclovir", "kytril",
    "granisetron", "bonviva", "ibandronic", "roferon", "interferon",
    "ro0228181", "roaccutane", "isotretinoin", "lariam", "mefloquine",
    "mircera", "methoxy polyethylene glycol-epoetin beta", "epoetin",
    "dormicum", "midazolam", "cellcept", "mycophenolate mofetil",
    "gazyva", "obinutuzumab", "ocrevus", "ocrelizumab", "xenical",
    "orlistat", "tamiflu", "oseltamivir", "pegasys", "peginterferon",
    "perjeta", "pertuzumab", "phesgo", "pertuzumab", "trastuzumab",
    "konakion", "phytomenadione", "polivy", "polatuzumab", "ranibizumab",
    "ranibizumab", "copegus", "ribavirin", "evrysdi", "risdiplam",
    "mabthera", "rituximab", "invirase", "saquinavir", "bactrim",
    "sulfamethoxazole", "ro0062580", "trimethoprim", "tnkase",
    "tenecteplase", "actemra", "tocilizumab", "kadcyla", "trastuzumab",
    "valcyte", "valganciclovir", "erivedge", "vismodegib",
]
BANNED_DIAGNOSTIC = [
    "cobas", "accu-chek", "accutrend", "coagucheck", "reflotron",
    "urisys", "sars-cov-2 rapid antibody test",
    "sars-cov-2 rapid antigen nasal test", "sars-cov-2 rapid antigen test",
    "ventana", "navify", "mysugr", "avenio", "lightcycler", "magna pure",
]
BANNED_TERMS = BANNED_PHARMA + BANNED_DIAGNOSTIC
# ---------------------------------------------------------------------------------------

# FIXED VALUES: the 32 ASCII punctuation characters (Python ``string.punctuation``).
PUNCTUATION = string.punctuation

# ---------------------------------------------------------------------------------------
# FIXED VALUES: English stop words of the NLTK corpus, in corpus order (179 words).
STOPWORDS_EN = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him",
    "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who",
    "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should",
    "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't",
    "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn",
    "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]
# ---------------------------------------------------------------------------------------


# FIXED VALUES: common English contractions and informal short forms, in lower case.
CONTRACTIONS = {
    "ain't": "is not", "aren't": "are not", "c'mon": "come on", "can't": "cannot", "can't've": "cannot have",
    "could've": "could have", "couldn't": "could not", "couldn't've": "could not have", "daren't": "dare not",
    "didn't": "did not", "doesn't": "does not", "don't": "do not", "everybody's": "everybody is",
    "everyone's": "everyone is", "hadn't": "had not", "hasn't": "has not", "haven't": "have not",
    "he'd": "he would", "he'll": "he will", "he's": "he is", "here's": "here is", "how'd": "how did",
    "how'll": "how will", "how're": "how are", "how's": "how is", "i'd": "I would", "i'll": "I will",
    "i'm": "I am", "i've": "I have", "isn't": "is not", "it'd": "it would", "it'll": "it will", "it's": "it is",
    "let's": "let us", "ma'am": "madam", "mayn't": "may not", "might've": "might have",
    "mightn't": "might not", "must've": "must have", "mustn't": "must not", "needn't": "need not",
    "nobody's": "nobody is", "nothing's": "nothing is", "o'clock": "of the clock", "oughtn't": "ought not",
    "shan't": "shall not", "she'd": "she would", "she'll": "she will", "she's": "she is",
    "should've": "should have", "shouldn't": "should not", "somebody's": "somebody is",
    "someone's": "someone is", "something's": "something is", "that'd": "that would", "that'll": "that will",
    "that's": "that is", "there'd": "there would", "there'll": "there will", "there're": "there are",
    "there's": "there is", "these're": "these are", "they'd": "they would", "they'll": "they will",
    "they're": "they are", "they've": "they have", "this'll": "this will", "those're": "those are",
    "wasn't": "was not", "we'd": "we would", "we'll": "we will", "we're": "we are", "we've": "we have",
    "weren't": "were not", "what'd": "what did", "what'll": "what will", "what're": "what are",
    "what's": "what is", "what've": "what have", "when's": "when is", "where'd": "where did",
    "where's": "where is", "where've": "where have", "who'd": "who would", "who'll": "who will",
    "who're": "who are", "who's": "who is", "who've": "who have", "why'd": "why did", "why's": "why is",
    "won't": "will not", "would've": "would have", "wouldn't": "would not", "y'all": "you all",
    "you'd": "you would", "you'll": "you will", "you're": "you are", "you've": "you have",
}
SHORT_FORMS = {
    "coulda": "could have", "cuz": "because", "dunno": "do not know", "gimme": "give me", "gonna": "going to",
    "gotta": "got to", "hafta": "have to", "imma": "I am going to", "kinda": "kind of", "lemme": "let me",
    "lotsa": "lots of", "lotta": "lot of", "mighta": "might have", "musta": "must have", "oughta": "ought to",
    "outta": "out of", "shoulda": "should have", "sorta": "sort of", "tryna": "trying to",
    "wanna": "want to", "woulda": "would have",
}
# What other words' endings stand for.
CONTRACTION_ENDINGS = {"n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'d": " would", "'m": " am"}

# Sentinels of the original output contracts.
NO_MATCH = "N/A"
MISSING_TIMESTAMP = "NA"
REMOVED_MARKERS = ["[removed]", "[deleted]"]

# Defaults of the normalization notebooks.
SEMANTIC_CUTOFF = 0.45
SEMANTIC_TOP_K = 3
NOISE_CATEGORIES = ["Noise"]
REPORT_EXCLUDED_CATEGORIES = ["uncategorized", "noise"]
UNCATEGORIZED = "uncategorized"
MIN_RESULT_CAP = 10
