"""Word tokens (X4) on sentences whose tokens are known, and beside the token estimate."""

import pytest

from quire.functions.text import token_count
from quire.functions.words import word_count, word_tokens

KNOWN = {
    "Good muffins cost $3.88\nin New York.  Please buy me\ntwo of them.\n\nThanks.":
        "Good muffins cost $ 3.88 in New York . Please buy me two of them . Thanks .",
    "They'll save and invest more.": "They 'll save and invest more .",
    "hi, my name can't hello,": "hi , my name ca n't hello ,",
    '"We beat some pretty good teams to get here," Slocum said.': "`` We beat some pretty good teams to get here , '' Slocum said .",
    "I cannot cannot work under these conditions!": "I can not can not work under these conditions !",
    "The company spent $30,000,000 last year.": "The company spent $ 30,000,000 last year .",
    "The company spent 40.75% of its income last year.": "The company spent 40.75 % of its income last year .",
    "He arrived at 3:00 pm.": "He arrived at 3:00 pm .",
    "I bought these items: books, pencils, and pens.": "I bought these items : books , pencils , and pens .",
    "Though there were 150, 100 of them were old.": "Though there were 150 , 100 of them were old .",
    "There were 300,000, but that wasn't enough.": "There were 300,000 , but that was n't enough .",
    "It's more'n enough.": "It 's more 'n enough .",
    "Dr. Smith met J. Doe at 5 p.m. today. She left.": "Dr. Smith met J. Doe at 5 p.m. today . She left .",
    "'Tis so, he said; 'twas (so he said) \"fine\".": "'T is so , he said ; 't was ( so he said ) `` fine '' .",
    "the dogs' bones ''x'' ... a--b I'm [gonna]": "the dogs ' bones `` x '' ... a -- b I 'm [ gon na ]",
    "«Où?» ¿Dónde está… él’s": "« Où ? » ¿Dónde está… él ’ s",
    "": "", "  \n ": "",
}


@pytest.mark.parametrize("text", list(KNOWN))
def test_known_tokens(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(word_tokens("t").alias("w"), word_count("t").alias("n")).first()
    assert " ".join(r.w) == KNOWN[text] and r.n == len(r.w)


def test_null_and_the_estimate_differ(spark):
    d = spark.createDataFrame([(None,), ("It's $3.50, isn't it?",)], "t string")
    got = [tuple(r) for r in d.select(word_count("t"), token_count("t")).collect()]
    assert got == [(None, None), (9, 13)]
