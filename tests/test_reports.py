import pytest

from riskframe.sources import reports

BASE = """--- Model A ---
Accuracy:  0.6906
Precision: 0.3582
Recall:    0.7079
F1-score:  0.4757
ROC AUC:   0.7693
PR AUC:    0.4599

Classification Report:
                  precision    recall  f1-score   support

Not Canceled (0)       0.90      0.69      0.78     12651
    Canceled (1)       0.36      0.71      0.48      3129


CM:
[[8682, 3969],
 [ 914, 2215]]"""

AT_THRESHOLD = """--- Model B at 0.4845 ---
Underlying PR AUC of the model: 0.4750
Classification Report:
    Canceled (1)       0.37      0.71      0.48      3129

Confusion Matrix:
[[8853, 3798],
 [ 917, 2212]]

more text
"""


def test_parse_files(spark, tmp_path):
    (tmp_path / "a_model.txt").write_text(BASE)
    (tmp_path / "b.txt").write_text(AT_THRESHOLD)
    parsed = reports.parse(reports.read_reports(spark, str(tmp_path)))
    got = {r["name"]: r for r in parsed.collect()}
    a, b = got["a_model"], got["b"]
    assert [a[m] for m in reports.COMPARED] == [0.3582, 0.7079, 0.4757, 0.4599, 0.7693]
    assert [b[m] for m in reports.COMPARED] == [0.37, 0.71, 0.48, 0.475, None]
    assert a["matrix_text"] == "[[8682, 3969],\n [ 914, 2215]]" == a["matrix_text"].strip()
    assert b["matrix_text"] == "[[8853, 3798],\n [ 917, 2212]]"
    assert a["report_text"].startswith("Classification Report:") and "3129" in a["report_text"]
    best = {r["name"]: r for r in reports.compare(parsed).collect()}
    assert best["b"]["best_precision"] and not best["b"]["best_roc_auc"] and best["a_model"]["best_roc_auc"]


def test_rendered_reports_are_read_back(spark, tmp_path):
    row = ("m1", 12512, 139, 2818, 311, 0.81262, 0.69111, 0.09939, 0.17379, 0.76432, 0.45454)
    found = spark.createDataFrame([row], "name string, tn long, fp long, fn long, tp long, accuracy double, precision double, "
                                         "recall double, f1_score double, roc_auc double, average_precision double")
    path = reports.write_reports(reports.render(found, "name"), str(tmp_path / "out"))
    got = reports.parse(reports.read_reports(spark, path)).first()
    assert got["name"] == "m1"
    assert [got[m] for m in reports.COMPARED] == pytest.approx([0.6911, 0.0994, 0.1738, 0.4545, 0.7643])
    assert got["matrix_text"] == "[[12512,   139],\n [ 2818,   311]]"
