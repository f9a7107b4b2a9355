from quirefold.llm import workers


def test_one_owner_at_a_time():
    a = workers.claim("a")
    a["x"] = 1
    assert workers.claim("a") == {"x": 1}
    assert workers.claim("b") == {} and a == {}
    assert workers.claim("a") == {}
