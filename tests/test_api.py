import tomolake


def test_exports():
    for name in tomolake.__all__:
        assert getattr(tomolake, name) is not None
    assert callable(tomolake.configure) and isinstance(tomolake.Study, type)
    try:
        tomolake.nothing
    except AttributeError:
        pass
    else:
        raise AssertionError
