"""Hand-written responses that reach the keyword branches of the task metrics; the text tables hold none of their words.

Each case is (response, expected output, question values, success).
"""

from __future__ import annotations

QUESTION = "Where would a person store old printed books safely"
CHOICES = [QUESTION, "library", "kitchen", "river", "garage", "attic", "library"]
LIST = ["Where are books kept?", "['library', 'kitchen', 'river']"]
REASON = "Books are kept in a library because a library is a quiet place that protects them."
LONG = "The answer is library. " + "It often makes sense since rooms differ. " * 12

CASES: list[tuple[str | None, str | None, list[str] | None, bool]] = [
    ("", "", [], True),
    ("   ", "library", CHOICES, True),
    ("library", "library", CHOICES, True),
    ("Library ", "library", CHOICES, True),
    ("library", "library", CHOICES, False),
    (None, "library", CHOICES, True),
    ("library", None, CHOICES, True),
    ("library", "library", None, True),
    ("The best answer is: 'library'", "the library", LIST, True),
    ("The answer should be 'river'.", "kitchen", LIST, True),
    ("I think the correct answer is kitchen, of course", "the kitchen is right", LIST, True),
    ("Answer: library. Let me know if you need more. Thank you!", "library", LIST, True),
    ("Question: one Question: two Question: three. Answer: river because of the reason and explanation.", "library", LIST, True),
    ("river or kitchen", "library", LIST, True),
    ("nothing of that", "library", LIST, True),
    (REASON, REASON, LIST, True),
    (REASON, "A library keeps books.", [QUESTION, "library"], True),
    ("So it is.", "library", [QUESTION, "library"], True),
    ("It is so, as everybody knows.", "library", [QUESTION, "library"], True),
    (LONG, "library", LIST, True),
    (LONG, "library", CHOICES, True),
    ("Same sentence here again. " * 4 + "Another thing. " * 8, "library", LIST, True),
    ("Same sentence here again. Same sentence here again. One more thing. Two more things now. Three more things. Four more things.", "library", LIST, True),
    ("\n".join(["the same line"] * 22), "library", LIST, True),
    ("\n".join(["the same line"] * 16 + [str(i) for i in range(3)]), "library", LIST, True),
    ("let me know if you need anything else, please let me know, have a great day, feel free to ask", "library", LIST, True),
    ("## Step 1 do it. The best answer is a. The correct answer is b. Would you like me to go on? What now? What then?", "library", LIST, True),
    ("0", "0", ["premise", "cause"], True),
    ("Hypothesis 1", "1", ["premise", "cause"], True),
    ("The correct hypothesis is 0 as stated", "0", ["premise", "cause"], True),
    ("Hypothesis 0 and not hypothesis: 1", "0", ["premise", "cause"], True),
    ("After a long consideration of everything that was said before, I would take 1 here", "1", ["premise", "cause"], True),
    ("10 of 11 cases", "1", ["premise", "cause"], True),
    ("none", "1", ["premise", "cause"], True),
    ("Water is defined as a liquid. It represents life, e.g. in rivers", "Water is a liquid.", ["cause", "effect"], True),
    ("1. First Tom walked\n\n2. then he fell (1999), et al. References: none", "Gravity pulls.", ["cause", "effect"], True),
    ("Here's why. One. Two! Three? Four. Five. Six", "Gravity pulls.", ["cause", "effect"], True),
    ("**Bold** start with step 3 in this case", "x", ["cause", "effect"], True),
    ("one two three four", "x", ["cause", "effect"], True),
    (" ".join(["word"] * 26), "x", ["cause", "effect"], True),
    (" ".join(["word"] * 101), "x", ["cause", "effect"], True),
    (" ".join(["word"] * 201), "x", ["cause", "effect"], True),
    ("My choice is 'attic'", "attic", ["storage", *CHOICES[:-1]], True),
    ("The answer is the old attic because it is dry.", "attic", CHOICES[:-1], True),
    ('Best choice: "garage"', "Garage!", CHOICES[:-1], True),
    ("kitchen, river and library are all fine", "river", CHOICES[:-1], True),
    ("they said 'under the bed'", "under the bed", CHOICES[:-1], True),
    ("no idea at all about this", "", CHOICES[:-1], True),
    ("The library is correct. The kitchen is not correct, the river is too vague, it does not make sense.\nHowever books need care.\n\nThus a dry room leads to long life.", "x", CHOICES, True),
    ("- kitchen\n- river", "- a\n- b", CHOICES, True),
    ("• kitchen\n* river\n- attic", "- a\n- b", CHOICES, True),
    ("1) kitchen\n2) river", "no list", CHOICES, True),
    ("Kitchen is a room. River is a stream. Garage is a place and attics are rooms, but dry.", "x", CHOICES, True),
    ("A kitchen means cooking. If it rains then rivers rise, either here or there. Although wet, it refers to water.", "x", CHOICES, True),
    ("Library library library library: unlike the other options, a library is used rather than the kitchen.", "x", CHOICES, True),
    ("A library keeps books. It is quiet. It is dry. It is safe. It is open.", "x", CHOICES, True),
    ("library, which is what people use when they, making a choice, and fitting all, but also if needed, keep things that are old and dusty and large and long and wide in the house", "x", CHOICES, True),
    ("Where would a person store old printed books safely person store printed books", "x", CHOICES, True),
    ("Corrected spelling and grammar; changed the tense.", "Fixed spelling, removed an error.", ["He go home now.", "He goes home."], True),
    ("nothing", "nothing", ["He go home now.", "He goes home."], True),
    ("spelling", "nothing", ["the a an", "x"], True),
    ("goes home now", "- spelling", ["  ", "x"], True),
    ("yes", "yes", ["q", "c", "a"], True),
    ("Yes", "yes", ["q", "c", "a"], True),
    ("yes.", "no", ["q", "c", "a"], True),
    ("Maybe!", "maybe", ["q", "c", "a"], True),
    ("YES!", "maybe", ["q", "c", "a"], True),
    ("no maybe", "no", ["q", "c", "a"], True),
    ("it may be so", "yes", ["q", "c", "a"], True),
    ("maybe", "yes", ["q", "c", "a"], True),
    ("maybe", "maybe", ["q", "c", "a"], True),
    ("It is maybe so, but the study of these patients did not have enough power to tell us", "odd", ["q", "c", "a"], True),
]
