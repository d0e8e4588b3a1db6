from pyspark.sql import functions as F
from pyspark.sql import types as T

from nadir.sources import readers as R
from nadir.sources import sinks as K
from nadir.streaming import ingest


def test_aliases_and_headers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Ligand SMILES\tKi (nM)\nC\t>5\n")
    df = R.resolve_columns(R.detect_header(spark, str(tmp_path / "a.tsv"), ["smiles", "ki_nm", "ligand_smiles"]), {"smiles": ["ligand_smiles"], "ki": ["Ki (nM)"], "none": []})
    assert df.first().asDict() == {"smiles": "C", "ki": ">5", "none": None}
    (tmp_path / "b.tsv").write_text("x\ty\n")
    assert R.detect_header(spark, str(tmp_path / "b.tsv"), ["p", "q"]).first().asDict() == {"p": "x", "q": "y"}


def test_optional_table(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert R.optional_table(spark, str(tmp_path / "no"), schema, spark.read.parquet).count() == 0


def test_wide_matrix(spark):
    df = spark.createDataFrame([("m1", 1.0, None), ("m2", 2.0, 3.0)], "model string, `A (1)` double, `B (22)` double")
    out = R.wide_matrix(df, "model").select("model", *R.symbol_and_id(), "value").collect()
    assert sorted(map(tuple, out)) == [("m1", "A", 1, 1.0), ("m2", "A", 1, 2.0), ("m2", "B", 22, 3.0)]


def test_line_formats(spark, tmp_path):
    cells = ["uniprotkb:P1", "uniprotkb:P2", "-", "-", "-", "-", 'psi-mi:"MI:0018"(x)', "-", "pubmed:123"] + ["-"] * 26 + ["true"]
    (tmp_path / "m.txt").write_text("#h\n" + "\t".join(cells) + "\n" + "\t".join([*cells[:35], "false"]) + "\n")
    assert tuple(R.mitab(spark, str(tmp_path / "m.txt")).first()) == ("P1", "P2", "MI:0018", "123")
    assert R.mitab(spark, str(tmp_path / "m.txt")).count() == 1
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\nchr1\t5\t.\tA\tC,<DEL>,G\t.\t.\tAF=0.1,0.2,0.3;DB\n")
    out = R.vcf(spark, str(tmp_path / "v.vcf")).select("chromosome", "position", "alt", R.per_allele("info", "AF").alias("af")).collect()
    assert sorted(map(tuple, out)) == [("1", 5, "C", "0.1"), ("1", 5, "G", "0.3")]
    (tmp_path / "p.txt").write_text("a b\nc\td\nbad\n")
    assert R.pair_list(spark, str(tmp_path / "p.txt")).count() == 2


def test_omics(spark):
    f = lambda rows: spark.createDataFrame(rows, "m string, g string, value double")
    out = R.omics_features(f([("a", "x", 1.0)]), f([("a", "y", 2.0)]), f([("a", "x", 3.0)]), ["m", "g"]).collect()
    assert sorted(map(tuple, out)) == [("a", "x", 1.0, 0.0, 3.0), ("a", "y", 0.0, 2.0, 0.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"))], "a long, b double").withColumn("s", F.struct(F.lit(1).alias("x")))
    assert K.flatten(df).columns == ["a", "b", "s_x"]
    assert '"b": null' in K.report(df) and K.markdown(df.drop("s")).startswith("| a | b |") and "\\begin{tabular}" in K.latex(df.drop("s"))
    K.parquet(df.drop("s"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1 and "Dataset" in K.croissant("n", "d", df)


def test_stream_dedup_and_upsert(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema("k long, v string, ts timestamp").parquet(str(src))
    q = ingest.deduplicated(stream, "ts", ["k"]).writeStream.foreachBatch(ingest.upsert_sink(str(tmp_path / "out"), ["k"], ["v"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    w = ingest.windowed(spark.read.parquet(str(src)), "ts", ["k"], "k")
    assert w.count() == 2


def test_gene_rows_and_drug_screens(spark):
    genes = spark.createDataFrame([("A (1)", 0.5, None), ("no id", 1.0, 2.0)], "gene string, L1 double, L2 double")
    assert sorted(map(tuple, R.gene_rows(genes, "gene").collect())) == [("A", 1, "L1", 0.5)]
    primary = spark.createDataFrame([(" m1 ", 1.0, None)], "id string, `B1::x::2.5` double, B2 double")
    assert [tuple(r) for r in R.screen_matrix(primary, "id").collect()] == [("m1", "B1", 1.0)]
    secondary = spark.createDataFrame([("B1::x", "", "m1", "0.5"), (None, "B2", None, "1"), (None, "B3", "m2", "x")], "broad_id string, column_name string, row_name string, auc string")
    assert sorted(map(tuple, R.screen_summary(secondary).collect())) == [("m1", "B1", 0.5, None, None), ("m2", "B3", None, None, None)]


def test_scored_links(spark, tmp_path):
    (tmp_path / "l.txt").write_text("protein1 protein2 combined_score\na b 900\nb a 900\na c 100\n")
    links = R.scored_links(spark, str(tmp_path / "l.txt"))
    assert links.count() == 3
    assert sorted(map(tuple, R.link_degrees(links, 400).collect())) == [("a", 1), ("b", 1)]


def test_variant_and_submission_summaries(spark, tmp_path):
    names = ["#AlleleID", "Type", "Name", "GeneID", "GeneSymbol", "ClinicalSignificance", "Assembly", "Chromosome", "Start", "ReferenceAllele", "AlternateAllele", "ReviewStatus", "NumberSubmitters", "PhenotypeIDS", "PhenotypeList", "VariationID", "PositionVCF", "ReferenceAlleleVCF", "AlternateAlleleVCF"]
    good = ["1", "Deletion", "NM_1.2(G):c.5C>A (p.Ala1Asp)", "-1", "G", "Likely benign", "GRCh38", "7", "9", "A", "T", "reviewed by expert panel", "2", "MedGen:C1,OMIM:2|Orphanet:3", "one|two", "11", "8", "na", "G"]
    rows = [good, [*good[:6], "GRCh37", *good[7:]], [*good[:9], "na", *good[10:]]]
    (tmp_path / "v.tsv").write_text("\n".join("\t".join(r) for r in [names, *rows]) + "\n")
    out = R.variant_summary(spark, str(tmp_path / "v.tsv")).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["variation_id"], r["position"], r["ref"], r["alt"], r["gene_id"], r["hgvs_coding"], r["hgvs_protein"], r["classification"], r["tier"]) == (11, 9, "A", "T", None, "NM_1.2:c.5C>A", "p.Ala1Asp", "likely_benign", "gold")
    assert [(p["medgen_cui"], p["omim_id"], p["name"]) for p in r["phenotypes"]] == [("C1", "2", "one")]
    (tmp_path / "s.txt").write_text("#Overview\n#VariationID:\tthe id\n#VariationID\tClinicalSignificance\tDateLastEvaluated\tDescription\tReportedPhenotypeInfo\tSCV\n11\tBenign\tJun 29, 2010\tBA1 met\tC0006142:x\tSCV1.3\n12\tother\t2024-03-14\t\t\tSCV2.1\nx\t\t\t\t\t\n")
    got = {r["variation_id"]: r for r in R.submission_summary(spark, str(tmp_path / "s.txt")).collect()}
    assert set(got) == {11, 12} and (got[11]["accession"], got[11]["year"], got[11]["acmg"], got[11]["medgen_cuis"], got[11]["classification"]) == ("SCV1", 2010, ["BA1"], ["C0006142"], "benign")
    assert (got[12]["year"], got[12]["classification"]) == (2024, None)
    assert R.submission_summary(spark, str(tmp_path / "s.txt"), spark.createDataFrame([(12,)], "variation_id long")).count() == 1


def test_annotated_vcf_header(spark, tmp_path):
    (tmp_path / "h.vcf").write_text('##INFO=<ID=AF,Number=A>\n##INFO=<ID=CSQ,Number=.,Description="Format: Allele|Consequence|SYMBOL">\n#CHROM\n')
    assert R.vcf_annotation_spec(spark, str(tmp_path / "h.vcf")) == ("CSQ", ["Allele", "Consequence", "SYMBOL"])


def test_vcf_with_repeated_keys_and_a_long_header(spark, tmp_path):
    spec = '##INFO=<ID={},Number=.,Description="Format: Allele|{}|SYMBOL">\n'
    head = "".join(f"##INFO=<ID=K{i},Number=1>\n" for i in range(1500)) + spec.format("CSQ", "Old") + spec.format("other", "X") + spec.format("vep", "Consequence")
    (tmp_path / "r.vcf").write_text(head + "#CHROM\nchr2\t7\t.\tA\tC\t.\t.\tAC=1;AC=2;DB;;X=a=b;E=\n3\t8\t.\tA\tC\t.\t.\tAC=1;AC\n")
    assert R.vcf_annotation_spec(spark, str(tmp_path / "r.vcf")) == ("vep", ["Allele", "Consequence", "SYMBOL"])
    got = [r["info"] for r in R.vcf(spark, str(tmp_path / "r.vcf")).orderBy("position").collect()]
    assert got == [{"AC": "2", "DB": None, "X": "a=b", "E": ""}, {"AC": None}]


def test_zip_keeps_lines_like_its_header(spark, tmp_path):
    import zipfile

    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("t.tsv", "a\tb\n1\t2\na\tb\n")
    assert sorted(tuple(r) for r in R.zipped(spark, str(tmp_path / "*.zip")).collect()) == [("1", "2")] * 2 + [("a", "b")] * 2


def test_zip_sniffing_and_config(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.tsv", "a\tb\n1\t2\n3\n")
    assert [tuple(r) for r in R.zipped(spark, str(tmp_path / "t.zip")).collect()] == [("1", "2"), ("3", None)]
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    assert R.sniffed(spark, str(tmp_path / "c.csv")).first().asDict() == {"a": "1", "b": "2"}
    (tmp_path / "c.json").write_text('{"x": [1]}')
    (tmp_path / "c.yaml").write_text("x:\n  - 1\n")
    assert R.config(str(tmp_path / "c.json")) == R.config(str(tmp_path / "c.yaml")) == {"x": [1]}


def test_merge_order_and_card(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (None, "n", 5)], "k int, v string, w int")
    new = spark.createDataFrame([(1, "A", None), (3, "c", 3), (None, "N", 6)], "k int, v string, w int")
    out = K.merged(old, new, ["k"], ["v", "w"]).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(1, "A", 1), (2, "b", None), (None, "N", 6), (3, "c", 3)]))
    K.ordered(old, str(tmp_path / "o"), ["v"])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
    assert "| k | int |" in K.dataset_card("x", {"t": old}, "cc0-1.0")
