from lineflow.config import Config, load


def test_layers_profile_and_mode():
    c = load(['[general]\nmax_lines = 10\nmode = "aggressive"\n[truncation]\ngrep = 7', '[general]\nmode = "balanced"\n[rules]\nalways_keep = ["a,b"]\n[commands]\npytest = "python"\nunknown = "x"'])
    assert (c.max_lines, c.mode, c.always_keep, c.mapping["pytest"], c.limit_for("grep"), c.limit_for("ls")) == (10, "balanced", ("a,b",), "python", 7, 10)
    assert Config(mode="aggressive").resolved().max_lines == 30
    g = Config(profile="gemini", mode="aggressive", limits={"grep": 5}).resolved()
    assert (g.mode, g.max_lines, g.truncate, g.limits) == ("conservative", 200, False, {"grep": 5, "find": 150})
