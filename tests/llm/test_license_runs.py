"""License texts wrapped over lines."""

from ensolith.llm import license_scan

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction'
BSD = " * Redistribution and use in source and binary forms, with or without\n *\n * modification, are permitted provided that the following conditions\n * are met:"


def test_wrapped_templates_are_found(spark):
    apart = MIT.split("\n")[0] + "\n" + "other words\n" * 30 + MIT.split("\n")[1]
    rows = [(1, MIT), (2, "a header\n\n" + BSD + "\n1. more"), (3, MIT.replace(" ", "\n\n")), (4, apart), (5, "released\nunder\nthe"), (6, "x " * 500 + "\nReleased under\nthe MIT\nlicense\n" + "y " * 500)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit-grant", 1.0), 2: ("bsd-clause", 1.0), 3: ("mit-grant", 1.0), 4: ("", 0.0), 5: ("", 0.0), 6: ("mit,mit-notice", 1.0)}
