"""Word lists, labels and patterns that results depend on. All can be replaced by parameters."""

from __future__ import annotations

# Rating labels and their scores.
RATING_LABELS = {"Not Helpful at All": 1, "Slightly Helpful": 2, "Neutral": 3, "Helpful": 4, "Very Helpful": 5}

# Column roles, searched in column names without regard to case.
RESPONSE_PATTERN = "response"
QUESTION_PATTERN = "(question|prompt|query)"
RATING_COLUMN = "Rating"

# Words, sentence ends.
WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"

# Connectives by category.
TEMPORAL = ["after", "afterward", "afterwards", "before", "earlier", "later", "meantime", "meanwhile", "subsequently", "then", "next", "finally", "first", "second", "third", "fourth", "ultimately", "previously", "simultaneously", "soon", "eventually"]
COMPARISON = ["however", "but", "nevertheless", "nonetheless", "yet", "though", "although", "whereas", "while", "instead", "in contrast", "on the other hand", "rather"]
CONTINGENCY = ["because", "since", "as", "so", "therefore", "thus", "hence", "consequently", "accordingly", "as a result", "resultantly", "due to", "owing to"]
EXPANSION = ["and", "also", "moreover", "furthermore", "in addition", "besides", "additionally", "namely", "for example", "for instance", "that is", "in other words"]
CONNECTIVES = {"temporal": TEMPORAL, "comparison": COMPARISON, "cause": CONTINGENCY, "expansion": EXPANSION}
ENUMERATION = ["first", "second", "third", "fourth", "fifth", "sixth"]

# Part-of-speech tags and entity labels that are counted.
POS_TRACKED = ["NOUN", "VERB", "ADJ", "ADV", "PRON", "PROPN", "AUX", "ADP", "DET", "CCONJ", "SCONJ", "PART", "NUM"]
POS_ALL = [*POS_TRACKED, "INTJ", "PUNCT", "SYM", "X"]
CONTENT_POS = ["NOUN", "PROPN", "VERB", "ADJ", "ADV"]
FUNCTION_POS = ["ADP", "AUX", "CCONJ", "DET", "PART", "PRON", "SCONJ"]
ENTITY_LABELS = ["PERSON", "ORG", "GPE", "LOC", "NORP", "FAC", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE", "PRODUCT", "DATE", "TIME", "PERCENT", "MONEY", "QUANTITY", "ORDINAL", "CARDINAL"]

# Closed classes of the rule tagger.
CLOSED_CLASSES = {
    "DET": "the a an this that these those each every some any no all both".split(),
    "PRON": "i you he she it we they me him her us them my your his its our their who whom which what".split(),
    "ADP": "of in on at by with from to for about over under between into through during against".split(),
    "AUX": "is are was were be been being am do does did has have had will would can could may might must shall should".split(),
    "CCONJ": "and or but nor".split(),
    "SCONJ": "because although if while since unless whereas as".split(),
    "PART": ["not", "n't"],
    "INTJ": ["oh", "ah", "hey"],
}
SUFFIXES = {"ADV": ["ly"], "VERB": ["ing", "ed", "ize", "ise"], "ADJ": ["ous", "ful", "ble", "ive", "ish", "al"]}

# Telling words of the rule tagger's entities.
TELLING_WORDS = {
    "FAC": ["airport", "bridge", "building", "highway", "stadium", "station", "street", "tower"],
    "LOC": ["bay", "desert", "island", "lake", "mount", "mountain", "ocean", "river", "sea", "valley"],
    "EVENT": ["championship", "cup", "festival", "games", "hurricane", "olympics", "revolution", "war"],
    "LAW": ["act", "amendment", "constitution", "law", "treaty"],
    "ORG": ["bank", "college", "company", "corp", "inc", "institute", "ltd", "ministry", "university"],
}
LANGUAGES = ["arabic", "chinese", "english", "french", "german", "hindi", "italian", "japanese", "latin", "portuguese", "russian", "spanish"]
PEOPLES = ["african", "american", "asian", "australian", "british", "canadian", "christian", "dutch", "european", "greek", "indian", "irish", "jewish", "mexican", "muslim", "roman", "turkish"]
MONEY_WORDS = ["cent", "cents", "dollar", "dollars", "euro", "euros", "pound", "pounds"]
TIME_WORDS = ["am", "hour", "hours", "minute", "minutes", "o'clock", "pm", "second", "seconds"]
QUANTITY_WORDS = ["cm", "feet", "foot", "gallons", "grams", "inches", "kg", "km", "kilograms", "kilometers", "liters", "litres", "meters", "metres", "miles", "mm", "tons"]

# A small polarity lexicon: word -> (valence from -4 to 4, polarity from -1 to 1, subjectivity from 0 to 1).
SENTIMENT = {
    "good": (1.9, 0.7, 0.6), "great": (3.1, 0.8, 0.75), "excellent": (2.7, 1.0, 1.0), "helpful": (1.8, 0.5, 0.4), "nice": (1.8, 0.6, 1.0),
    "love": (3.2, 0.5, 0.6), "best": (3.2, 1.0, 0.3), "happy": (2.7, 0.8, 1.0), "clear": (1.6, 0.1, 0.38), "useful": (1.9, 0.3, 0.0),
    "bad": (-2.5, -0.7, 0.67), "terrible": (-2.1, -1.0, 1.0), "worthless": (-1.9, -0.8, 0.9), "pathetic": (-2.3, -1.0, 1.0), "stupid": (-2.4, -0.8, 1.0),
    "idiot": (-2.3, -0.8, 0.8), "moron": (-2.2, -0.8, 0.9), "loser": (-2.4, -0.2, 0.3), "trash": (-1.5, -0.4, 0.6), "scum": (-2.6, -0.7, 0.9),
    "disgusting": (-2.4, -1.0, 1.0), "hate": (-2.7, -0.8, 0.9), "wrong": (-2.1, -0.5, 0.9), "confusing": (-0.9, -0.3, 0.4), "clown": (-0.8, -0.2, 0.5),
}
NEGATIONS = ["not", "no", "never", "without", "cannot", "nor"]
BOOSTERS = {"very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "slightly": -0.293, "somewhat": -0.293}
NEGATION_FACTOR, COMPOUND_ALPHA = -0.74, 15.0

# Named feature sets and the fixed effects of the mixed model.
COMBOS = {
    "combo_4_A__embed_nli_pos_read": ["cosine_sim", "q_norm", "r_norm", "norm_gap", "nli_mean_entail", "nli_mean_contra", "nli_max_contra", "nli_frac_entail_gt50", "nli_frac_contra_gt50", "content_vs_function_ratio", "pronoun_ratio", "verbs_per_sentence", "pos_entropy", "flesch_reading_ease", "fk_grade_level", "gunning_fog", "smog_index", "ari", "coleman_liau"],
    "combo_5_B__perp_token_curv_lex_disc": ["avg_logprob", "ppl", "proportion_top10", "proportion_top100", "proportion_top1000", "mean_rank", "rank_entropy", "curvature_z", "ll_orig", "mean_ll_pert", "std_ll_pert", "ttr", "rttr", "cttr", "herdan_c", "maas_a2", "yules_k", "mtld", "hapax_ratio", "dis_legomena_ratio", "avg_word_len", "total_connectives", "connective_entropy", "connective_density_per_100w", "enumeration_count"],
    "combo_5_C__dep_grid_ner_sent_len": ["avg_tree_depth", "max_tree_depth", "std_tree_depth", "avg_dep_distance", "root_children_mean", "unique_entities", "avg_entities_per_sent", "entity_continuity", "entity_introductions", "role_transitions", "grid_density", "entity_count", "entity_density", "unique_entity_types", "entity_label_entropy", "avg_entity_length_tokens", "vader_compound", "tb_subjectivity", "sentence_length"],
    "combo_8_D__embed_nli_pos_read_lex_dep_grid_sent": ["cosine_sim", "norm_gap", "nli_mean_entail", "nli_mean_contra", "content_vs_function_ratio", "pos_entropy", "verbs_per_sentence", "flesch_reading_ease", "fk_grade_level", "ttr", "mtld", "yules_k", "avg_tree_depth", "avg_dep_distance", "entity_continuity", "role_transitions", "vader_compound", "tb_subjectivity", "sentence_length"],
    "combo_11_E__add_perp_token_ner_disc": ["cosine_sim", "norm_gap", "nli_mean_entail", "nli_mean_contra", "content_vs_function_ratio", "pos_entropy", "verbs_per_sentence", "flesch_reading_ease", "fk_grade_level", "ttr", "mtld", "yules_k", "avg_tree_depth", "avg_dep_distance", "entity_continuity", "role_transitions", "vader_compound", "tb_subjectivity", "sentence_length", "avg_logprob", "ppl", "proportion_top100", "entity_density", "entity_label_entropy", "connective_entropy", "connective_density_per_100w"],
    "combo_ALL": ["__ALL__"],
}
FIXED_EFFECTS = ["cosine_sim", "nli_mean_entail", "content_vs_function_ratio", "pos_entropy", "verbs_per_sentence", "flesch_reading_ease", "ttr", "mtld", "avg_tree_depth", "entity_continuity", "vader_compound", "tb_subjectivity", "avg_logprob", "sentence_length"]

# Decimal places of output columns, by family; what is not named has PLACES.
PLACES, RATING_PLACES = 4, 2
FAMILY_PLACES = {"sentence_length": 2, "perplexity": 3, "token_ranks": 2, "dependency": 3}
SHARE_COLUMNS = ["proportion_top10", "proportion_top100", "proportion_top1000", "proportion_over1000"]
