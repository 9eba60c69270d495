from __future__ import annotations

import json

from barloom.__main__ import main


def test_convert_run_and_report(spark, tmp_path, capsys):
    rows = "".join(f"2025-08-{1 + i // 24:02d}T{i % 24:02d}:00:00.000Z,{p}.00,{p + 2}.00,{p - 2}.00,{p + 1}.00,1.5\n" for i in range(240) for p in [100 + (i * 7) % 40])
    (tmp_path / "b.csv").write_text("timestamp,open,high,low,close,volume\n" + rows)
    main(["convert", str(tmp_path / "b.csv"), "--to", str(tmp_path / "b.tape")], spark)
    assert capsys.readouterr().out == "240 bars\n"
    for source in ("b.csv", "b.tape"):
        main(["run", str(tmp_path / source), "--params", json.dumps({"fast": 3, "slow": 9, "qty": 25000}), "--store", str(tmp_path / "store"), "--run-id", source, "--json", str(tmp_path / f"{source}.json"), "--flatten", "--preset", "binanceSpot"], spark)
    made = [json.loads((tmp_path / f"{s}.json").read_text()) for s in ("b.csv", "b.tape")]
    assert made[0] == made[1] and made[0]["trades"]["count"] > 5 and made[0]["period"]["bars"] == 240
    capsys.readouterr()
    main(["report", "--store", str(tmp_path / "store"), "--run-id", "b.csv", "--html", str(tmp_path / "r.html")], spark)
    assert "commissionPaid" in capsys.readouterr().out and "<svg" in (tmp_path / "r.html").read_text()
