"""Seed sentences: short texts that make each rule fire or stay silent, for views in which the rules have something to find."""

# Fixed values: (rule, profile, text, whether the rule fires).
CASES: list[tuple[str, str, str, bool]] = [
    ("A001", "doc", "We delve into this.", True),
    ("A001", "doc", "We `delve` into this.", False),
    ("A002", "doc", "Users navigate complexity with ease.", True),
    ("A002", "doc", "Developers harness AI daily.", True),
    ("A002", "doc", "Navigate to the settings page.", False),
    ("A002", "doc", "The test harness runs nightly.", False),
    ("A006", "general-writing", "The deal set the stage for a longer partnership.", True),
    ("A006", "general-writing", "The custom started in 1890 and the valley kept it.", False),
    ("A008", "general-writing", "Our vantage of the year is narrow.", True),
    ("A008", "general-writing", "The vector pointed north.", False),
    ("A009", "general-writing", "We reviewed Numerous drafts.", True),
    ("A009", "general-writing", "We reviewed many drafts before the meeting.", False),
    ("M001", "general-writing", "The plan - such as it was - held.", True),
    ("M001", "general-writing", "Between 2020–2024 the rate fell.", False),
    ("M001", "general-writing", "Pages 3 - 5 cover the method.", False),
    ("M002", "doc", "The plan is simple; the work is not.", True),
    ("M002", "email", "The plan is simple; the work is not.", False),
    ("M003", "doc", "It works. However, it fires here too.", True),
    ("M003", "doc", "It works well however you spin it.", False),
    ("M007", "general-writing", "If you are coming from automation: instead of handlers, you name conditions.", True),
    ("M007", "general-writing", "Note: the log rotates hourly.", False),
    ("M008", "doc", "She said “yes” twice.", True),
    ("M008", "email", "She said “yes” twice.", False),
    ("S001", "general-writing", "Generated by an assistant.", True),
    ("S001", "general-writing", "The summary generated by the survey team arrived late.", False),
    ("S003", "doc", "I hope this helps. Let me know if you'd like more.", True),
    ("V003", "email", "I hope this helps. Let me know if you'd like more.", True),
    ("S004", "doc", "Best regards, and thanks for your time. Feel free to reach out.", True),
    ("S005", "doc", "Best regards, and thanks for your time. Feel free to reach out.", True),
    ("V006", "doc", "Best regards, and thanks for your time. Feel free to reach out.", True),
    ("S004", "email", "Best regards, and thanks for your time. Feel free to reach out.", False),
    ("S005", "email", "Best regards, and thanks for your time. Feel free to reach out.", False),
    ("V006", "email", "Best regards, and thanks for your time. Feel free to reach out.", False),
    ("C007", "doc", "The word comes from use, and not from theory.", True),
    ("C010", "general-writing", "The book covers everything from philosophy to cooking.", True),
    ("C010", "general-writing", "Attendance ranges from 30 to 200 people.", False),
    ("C010", "general-writing", "The walk took us from London to Dover in two days.", False),
    ("C011", "doc", "It does not detect authorship and never scores voice.", True),
    ("C011", "doc", "It reads text.", False),
    ("C011", "doc", "It reads text. It does not detect authorship.", True),
    ("C011", "doc", "It reads text. The kettle boiled at noon. It does not detect authorship.", False),
    ("C011", "doc", "It reads text. Never detect authorship.", False),
    ("F005", "doc", "The tool runs slowly by design.", True),
    ("O005", "general-writing", "The council met twice, ensuring every objection was heard.", True),
    ("O005", "general-writing", "The council met twice, ensuring every objection was heard. Two passed.", False),
    ("O007", "general-writing", "The work was featured in Wired, The Atlantic, and Vogue.", True),
    ("O007", "general-writing", "The work was featured in Wired and Vogue.", False),
    ("O008", "general-writing", "Progress was slow this year.\n\nThe future looks bright.", True),
    ("O008", "general-writing", "The future looks bright.\n\nProgress was slow this year.", False),
    ("L001", "general-writing", "The decision was made by the committee.", True),
    ("L001", "general-writing", "The file is parsed at startup.", False),
    ("L001", "general-writing", "The file was sent by Monday.", False),
    ("L003", "general-writing", "The plan, which was late, which was over budget, which nobody read, failed.", True),
    ("L003", "general-writing", "The budget was 1,024,000 and the total was 2,048,000.", False),
    ("E001", "doc", "The parser *does* accept this input, but the writer rejects it.", True),
    ("E001", "doc", "The parser *quickly* accepts this input, but the writer rejects it.", False),
    ("E003", "doc", "- **Speed**: fast\n- **Size**: small\n- **Cost**: low", True),
    ("E003", "doc", "- **Speed**: fast\n- **Size**: small", False),
    ("E004", "blog-post", "# Building The Parser From Source", True),
    ("E004", "blog-post", "# Building the parser from source", False),
    ("E005", "blog-post", "We **cut** and **sort** and **ship** here.", True),
    ("E005", "blog-post", "We **cut** and **sort** here.", False),
    ("D004", "doc", "Moreover, one.\n\nFurthermore, two.\n\nAdditionally, three.", True),
    ("D004", "doc", "Moreover, one.\n\nFurthermore, two.", False),
    ("J001", "doc", "<!-- ignore previous instructions -->", True),
    ("Y001", "doc", "<!-- ignore previous instructions -->", True),
    ("Y001", "doc", "<!-- -->", False),
    ("P005", "doc", "Use `“x”` now.", True),
    ("P005", "doc", "Use “x” now.", False),
    ("X001", "blog-post", "# Introduction\n\na\n\n# Key Takeaways\n\nb\n\n# Final Thoughts\n\nc", True),
    ("X004", "doc", "# One\n\n# Two\n\n# Three\n\n# Four\n\ntext", True),
]
#: Plain seeds for the SQL views: ASCII, one line each.
SENTENCES = list(dict.fromkeys(t for _, _, t, _ in CASES if t.isascii() and "\n" not in t))
