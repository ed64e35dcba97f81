from __future__ import annotations

import duckdb
import pytest

from curdline.llm import licenses as op
from curdline.llm import queries
from curdline.llm.oracle import licences_sql
from tests.compare import difference, duck
from tests.llm.helpers import DOCUMENTS, docs

MIT = dict(op.SENTENCES)
FULL = "\n\n".join(["MIT License", MIT["mit_grant"].replace("free of charge, ", "free of charge,\n"), MIT["mit_condition"], MIT["as_is"]])
GNU = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public "
       "License as published by the Free Software Foundation; either version {} of the License, or (at your option) any\nlater version.")

CASES = [
    ("Some words.\nLicensed under the Apache License, Version 2.0.", "apache_notice", "Apache-2.0"),
    ("no full stop\nReleased under the MIT License.\nmore", "mit_notice", "MIT"),
    (FULL, "mit_title mit_grant mit_condition as_is", "MIT"),
    (FULL + " tail.\nAll rights reserved.", "mit_title mit_grant mit_condition as_is all_rights", "MIT proprietary"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in\ncompliance with the License. '
     "Licensed under CC BY-NC 4.0.", "apache_header apache_comply cc_by_nc_notice", "Apache-2.0 CC-BY-NC-4.0"),
    ("you may not use this file except in compliance with the License.", "apache_comply", "unknown"),
    ("RELEASED   UNDER THE mit LICENSE! Released under the MIT License.", "mit_notice mit_notice", "MIT"),
    (f"This program is free software: {MIT['gpl3_later']}", "gpl_free gpl3_later", "GPL-3.0-or-later"),
    (f"This program is free software: {MIT['gpl2_later']}", "gpl_free gpl2_later", "GPL-2.0-or-later"),
    (GNU.format("General", "2"), "gpl_free gpl_terms version2_later", "GPL-2.0-or-later"),
    (GNU.format("General", "3"), "gpl_free gpl_terms version3_later", "GPL-3.0-or-later"),
    (GNU.format("Affero General", "3"), "gpl_free agpl_terms version3_later", "AGPL-3.0-or-later"),
    (GNU.format("Lesser General", "2.1").replace("program", "library"), "library_free lgpl_terms version2_1_later", "LGPL-2.1-or-later"),
    (GNU.format("General", "7"), "gpl_free gpl_terms", "unknown"),
    ("Copyright (c) 2020 Jane Doe, All rights reserved.", "all_rights", "proprietary"),
    ("a title\nCopyright 1999-2004 Mill & Sons all rights reserved\nmore", "all_rights", "proprietary"),
    ("Copyright is a right. No rights reserved", None, None),
    (f"{MIT['bsd_grant']}\n\n1. {MIT['bsd_source']}\n2. {MIT['bsd_binary']}\n", "bsd_grant bsd_source bsd_binary", "BSD-2-Clause"),
    (f"{MIT['bsd_grant']}\n1. {MIT['bsd_source']}\n2. {MIT['bsd_binary']}\n3. {MIT['bsd_names']}",
     "bsd_grant bsd_source bsd_binary bsd_names", "BSD-3-Clause"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "mpl2_terms", "MPL-2.0"),
]


def test_cases(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)] + [(50, None), (51, ""), (52, "not released under the MIT License at all. x"), (53, "w " * 200_000)]
    found = {r.doc_id: (r.sentences, r.licences) for r in op.licences(docs(spark, rows).selectExpr("*", "1 as found")).collect()}
    assert found == {i: c[1:] for i, c in enumerate(CASES) if c[1]}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    ours = queries.queries()[name](spark, sf_dir).toPandas()
    assert len(ours) and difference(ours, duck(sf_dir).sql(queries.oracle_sql()[name]).df()) is None


def test_repeated_rows_and_empty_table(spark):
    given = docs(spark, [(1, CASES[0][0]), (1, CASES[0][0]), (None, CASES[0][0])])
    assert op.licences(given).count() == 3
    assert op.licences(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_oracle_on_cases(spark, tmp_path):
    """The SQL over texts that hold every wording and its neighbours."""
    docs(spark, list(enumerate([c[0] for c in CASES]))).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours = op.licences(spark.read.parquet(str(tmp_path / "documents.parquet"))).toPandas()
    assert difference(ours, con.sql(licences_sql()).df()) is None


def test_wordings_are_not_cut(monkeypatch):
    monkeypatch.setattr(op, "SENTENCES", (*op.SENTENCES, ("cut", "One part; another part.")))
    with pytest.raises(ValueError, match="cut"):
        op.known_sentences()
