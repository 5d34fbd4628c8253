"""Texts that operators must cope with, and the small tables."""

SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", "   ", "a", "Hello  world\n\n  it's don't <|endoftext|> x", "  lead", "trail \n", "tab\tx y", "é ² ½ ⅷ ٣ 漢字 かな", "x᠎y z​w ﻿q",
    "it's we're I'll 'd 's' 12345 67 ...!!", "a" * 3000, "word " * 5000, "\x1c\x1d a\x1fb", " nb sp", "🙂 smile 👩‍👩‍👧 fam", "ÉCOLE école İstanbul ΣΑΣ", "<|startoftext|> hey <|endoftext|>", "é combining  x", "\n\n a", "a \n b", "end<|endoftext|>", "a   b    c \t d", "One.\nTwo,\n\nThree!? x.\n 4.\n", "H\u0331 A\u030a <|ENDOFTEXT|> 's.\n's don't. y'", "a.\u180e\nb é, É. 7% ²! x|",
]
